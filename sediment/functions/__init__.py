"""Column functions: hashes, Bloom probes, record and frame codecs."""
