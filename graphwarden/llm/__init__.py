"""Training-data operators: language, quality, duplicates, leaks, secrets, personal data, tokens."""
