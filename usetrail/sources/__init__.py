"""Corpus readers, test views and sinks."""
