"""Readers, writers, merges and caches."""
