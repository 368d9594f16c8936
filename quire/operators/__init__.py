"""Reusable distributed operators: ordered indices and running sums, similarity, metrics, authors, sampling, losses."""
