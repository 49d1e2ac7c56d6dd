"""Readers, page and payload scans, and sinks."""
