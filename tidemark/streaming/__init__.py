"""Structured Streaming jobs for log ingestion, daily counts and the coverage ledger."""
