"""The same state from a stream of ops."""
