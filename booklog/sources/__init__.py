"""Readers: log text, broker topics, stored batches, snapshots and serving tables."""
