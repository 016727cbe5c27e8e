"""Training-data operators: filters, scans, searches, near-duplicate detection, tokens and packing."""
