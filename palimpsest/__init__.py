"""Palimpsest: comparing document revisions, and preparing training text, on Spark."""
