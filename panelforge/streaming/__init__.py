"""Structured Streaming counterparts of ingest, roll-up, quality and scoring."""
