"""Column functions: hashing, vectors, itemset keys."""
