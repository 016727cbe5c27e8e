"""Column functions: exact 64-bit arithmetic, keys, buckets and requests."""
