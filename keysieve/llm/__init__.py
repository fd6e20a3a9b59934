"""Training-data operators: deduplication, tokenisation, mixing, filters, scoring and search."""
