"""Op logs, the durable store and its binary files."""
