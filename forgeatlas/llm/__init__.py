"""Training-data operators: tokenizing, quality, secrets, duplicates, contamination."""
