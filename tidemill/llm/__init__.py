"""Training-data operators: deduplication, classification, scanning, tokenising and ordering of documents."""
