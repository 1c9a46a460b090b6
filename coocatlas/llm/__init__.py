"""Training-data operators: scoring, extraction, formatting, filtering, deduplication, sharding and packing."""
