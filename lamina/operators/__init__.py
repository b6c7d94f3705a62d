"""Operators over layers of annotations."""
