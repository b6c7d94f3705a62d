"""Queries over the tables of a folder, and SQL that gives the same results."""
