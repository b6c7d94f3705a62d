"""Readers that make layers, and writers that store them."""
