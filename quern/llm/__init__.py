"""Training-data operators: dedup, decontamination, quality, mixing, extraction, scoring, archives."""
