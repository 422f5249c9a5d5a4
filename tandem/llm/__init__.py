"""Training-data operators: deduplication, quality, safety, packing, search, encoding, archives."""
