"""Training-data operators: privacy, quality, duplicates, contamination, toxicity, language, mixing and chat text."""
