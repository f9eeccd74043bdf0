"""Streams: chunks as books arrive, and windowed counts of events."""
