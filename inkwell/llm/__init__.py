"""Training-data operators: archives, quality, packing, mixing, privacy, token files, de-duplication."""
