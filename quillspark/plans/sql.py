"""SQL out of the same fixed templates that queries fill."""

from __future__ import annotations

import re

#: The content tokens of SQL's x, without the words of a list.
TOKENS = r"list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) >= 4 AND NOT list_contains({stop}, w))"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(words: list[str] | tuple[str, ...]) -> str:
    return "[" + ", ".join(map(lit, words)) + "]"


def said(template: str, **holes: str) -> str:
    """The template as SQL, its holes filled by expressions."""
    parts = re.split(r"\{(\w+)\}", template)
    return " || ".join(f"({holes[x]})" if i % 2 else lit(x) for i, x in enumerate(parts) if x)


def when(condition: str, text: str, otherwise: str = "''") -> str:
    return f"CASE WHEN {condition} THEN {text} ELSE {otherwise} END"


def words(x: str, stop: list[str] | tuple[str, ...] = ("",)) -> str:
    return TOKENS.format(x=x, stop=listed(stop))
