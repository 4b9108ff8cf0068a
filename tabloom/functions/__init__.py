"""Column functions: factors, layout arithmetic, hashing, blobs, packing, generators."""
