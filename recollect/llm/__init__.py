"""Training-data operators: cleaning, dedup, decontamination, mixing and formatting."""
