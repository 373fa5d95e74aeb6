"""Training-data operators: quality, dedup, filtering, sharding and packing."""
