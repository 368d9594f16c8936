"""Readers and writers: driver-table fixtures, JSONL corpora, id maps, score matrices, sinks."""
