"""Training-data operators: toxicity, near-duplicates, tokenizers, language model, mixing, personal data, quality, search."""
