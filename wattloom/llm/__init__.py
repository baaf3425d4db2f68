"""Training-data operators: sanitising, deduplication, mixing, packing, search and extraction."""
