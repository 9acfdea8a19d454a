"""Structured Streaming jobs: incremental replication and the state watch."""
