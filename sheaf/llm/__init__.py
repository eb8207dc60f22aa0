"""Training-data operators: fingerprints, deduplication, packing, language ID, search, scans, extraction, mixing."""
