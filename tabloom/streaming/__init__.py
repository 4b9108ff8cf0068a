"""Chunks of rows and columns, and append sinks."""
