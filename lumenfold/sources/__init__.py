"""Readers, ingestion and sinks."""
