"""Readers, record mappings and sinks."""
