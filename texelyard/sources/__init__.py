"""Scans of files and archive listings, and sinks."""
