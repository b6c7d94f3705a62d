"""Layers of documents that arrive as a stream."""
