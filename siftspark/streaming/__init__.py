"""Resuming work, and an incremental ingest. The original is batch only; the ingest is an extension."""
