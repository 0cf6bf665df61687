"""Training-data operators: deduplication, mixing, filtering, scoring, sharding."""
