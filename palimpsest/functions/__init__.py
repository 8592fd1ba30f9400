"""Text rules: as Python functions for the kernels, and as native Spark columns."""
