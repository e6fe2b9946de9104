"""Scans and sinks: explicit schemas, checked while reading."""
