"""Training-data operators: token files, piece tokenizing, dedup, media, sharding, mixing, extraction, scoring, language ID."""
