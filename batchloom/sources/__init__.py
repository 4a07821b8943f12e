"""Readers, writers and the epoch-committed event store."""
