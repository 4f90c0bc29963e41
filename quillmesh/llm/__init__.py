"""Training-data operators: deduplication, filtering, classification and mixing of documents."""
