"""Training-data operators: filtering, deduplication, tokenising, packing and archiving of text corpora."""
