"""Training-data operators: quality rules, secret, licence and repetition
scans, near-duplicate search, packing, mixing, fingerprints, chat formatting
and token-count rollups. Nothing else in the library imports this package."""
