"""Comparison of revisions as they arrive."""
