"""Training-data pipeline operators: mixing, media, fingerprints, archives, URL
lists, near-duplicate joins, tokenizing, extraction, toxicity and language.

Nothing else in the library imports this subpackage."""
