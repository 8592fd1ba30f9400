"""Training-data operators: deduplication, joins, scoring, extraction, tokens."""
