"""Relational plans around the kernels, and the registered queries."""
