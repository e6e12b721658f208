"""Model operators: cleaning/splitting, baseline, neighbourhood, ALS."""
