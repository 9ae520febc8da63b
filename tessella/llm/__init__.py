"""Training-data operators: deduplication, decontamination, filtering, tokens, packing and formats."""
