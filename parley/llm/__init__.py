"""Training-data operators: deduplication, language, quality, mixing, secrets, extraction, tokenization."""
