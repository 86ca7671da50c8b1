"""Structured Streaming versions of ingestion and lifecycle tracking."""
