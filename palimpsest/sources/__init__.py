"""Where pairs of texts come from."""
