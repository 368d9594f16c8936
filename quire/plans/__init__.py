"""User-level pipelines (scoring, diversity, pairs, from files) and the registry of queries with their oracles."""
