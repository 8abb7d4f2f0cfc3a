"""All queries over the reference tables, by name."""

from __future__ import annotations

from . import extraction, learning, pages, review, search, sections, store

_PLANS = (search, pages, extraction, learning, review, store, sections)
QUERIES = {k: f for p in _PLANS for k, f in p.QUERIES.items()}
SQL = {k: s for p in _PLANS for k, s in p.SQL.items()}
