"""Comparison kernels (no Spark import) and the DataFrame operators around them."""
