"""Structured Streaming jobs that share their rules with the batch operators."""
