"""Incremental passes and streams."""
