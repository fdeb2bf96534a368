"""Training-data operators: packing, deduplication, quality, mixing, tokens, archives."""
