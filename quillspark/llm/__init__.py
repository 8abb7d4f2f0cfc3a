"""Operators for preparing language-model training data.

Each module holds one operator with a general interface and the thin registered query that applies it.
Nothing outside this subpackage imports it.
"""
