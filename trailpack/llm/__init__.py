"""Training-data operators: filtering, de-duplication, formats and packing for text corpora."""
