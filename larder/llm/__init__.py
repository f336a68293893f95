"""Training-data operators: secrets, dedup, decontamination, mixing, tokens."""
