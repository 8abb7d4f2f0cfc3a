"""Operators over long, keyed tables."""
