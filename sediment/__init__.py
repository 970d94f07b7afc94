"""sediment: a Spark-native engine for keyed, last-writer-wins op logs."""
