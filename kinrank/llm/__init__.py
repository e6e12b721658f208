"""Training-data operators: dedup, decontamination, quality, PII, mixing, output."""
