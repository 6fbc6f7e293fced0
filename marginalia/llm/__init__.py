"""Training-data operators: deduplication, scoring, search, packing and redaction on Spark."""
