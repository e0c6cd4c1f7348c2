"""Training-data operators: deduplication, scoring, mixing, sharding and counting."""
