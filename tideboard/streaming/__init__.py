"""The same work on file streams."""
