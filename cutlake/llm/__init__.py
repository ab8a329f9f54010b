"""Training-data operators over documents: scoring, filtering, deduplication, tokenising, packing, search."""
