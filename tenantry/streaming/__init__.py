"""Structured Streaming forms of tenant-scoped reads (an extension)."""
