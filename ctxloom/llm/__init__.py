"""Operators for preparing training text: fingerprints, mixing, packing, quality, personal data, archives,
near-duplicate joins, toxicity, vector search and substring removal.  Nothing else in ctxloom imports this package."""
