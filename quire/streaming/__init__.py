"""The epoch feed: one idempotent batch job per epoch (the reference has no event-time streaming)."""
