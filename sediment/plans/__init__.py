"""The query catalog and its SQL."""
