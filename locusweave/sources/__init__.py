"""Readers, text parsers, schemas and sinks."""
