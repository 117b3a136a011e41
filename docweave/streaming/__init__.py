"""Structured Streaming jobs: the batch operators, run on micro-batches."""
