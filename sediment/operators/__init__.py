"""Operators over op logs: state, generations, Bloom filters, the ring, workloads."""
