"""Training-data operators: deduplication, packing, mixing, scans and scores."""
