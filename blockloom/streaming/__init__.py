"""Structured Streaming fronts of the batch operators."""
