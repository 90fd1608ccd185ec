"""Readers, source standardisation and sinks."""
