"""Readers, table store and file sinks."""
