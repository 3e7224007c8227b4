"""Training-data operators: deduplication, tokenising, scoring, extraction, filtering and packing."""
