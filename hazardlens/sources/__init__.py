"""Readers: landed documents, JSON streams and stored tables."""
