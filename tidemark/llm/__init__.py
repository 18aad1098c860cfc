"""Operators of a training-data pipeline: scoring, deduplication, decontamination, mixing, search and token output."""
