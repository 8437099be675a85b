"""Training-data operators: scans, fingerprints, filters, mixing, scoring, formatting, packing and deduplication."""
