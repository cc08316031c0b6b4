"""Training-data operators: filtering, deduplication, mixing, packing, token files and search."""
