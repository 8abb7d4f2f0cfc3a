"""Tokenisers, token-set measures, page quality and edit classes, as column expressions.

Four tokenisers stay apart on purpose: search, measures, wording rules and diffs each count tokens in their own way.
"""

from __future__ import annotations

import re
from functools import reduce
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import DATE_FORMATS
from .spans import let

#: A run of letters, digits and underscores of any script; letters and digits; white space.
WORD, ALNUM, SPACE = r"[\p{L}\p{N}_]+", r"[\p{L}\p{N}]+", r"[\x09-\x0D\x1C-\x20\x85\p{Z}]"
#: The words that measures don't count.
STOPWORDS = (
    "the a an and or of to in on for with by is are was were be been being as at this that these those it its from into but if any no not must should shall will may can "
    "each every all some such than then so also which who whom what when where how"
).split()
#: The words that don't tie a draft to its evidence.
GENERIC_WORDS = "must should shall will with from this that these those have been into before after each every their there where which while until than then also".split()
#: Substrings whose coming or going makes an edit a change of citation.
CITATION_MARKS = ("book", "page", "instrument", "schedule", "exhibit", "deed")

BUCKETS_DENSE, BUCKETS_SPARSE = 384, 1024


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def search_tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, lower-cased; accents split words."""
    return _all(F.lower(text), "[a-z0-9]+")


def content_tokens(text: Column, stop: list[str] | tuple[str, ...] = tuple(STOPWORDS)) -> Column:
    """Different words of 4 or more characters, of any script, that aren't stop words."""
    words = _all(F.lower(text), WORD)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(*stop)))


def rule_words(text: Column) -> Column:
    """Words that begin with a letter, of 2 or more characters, lower-cased."""
    return F.transform(_all(text, "[A-Za-z][A-Za-z0-9_-]+"), F.lower)


def diff_tokens(text: Column) -> Column:
    """Runs of letters and digits, of any script, of 3 or more characters."""
    return F.filter(_all(F.lower(text), ALNUM), lambda w: F.length(w) >= 3)


def terms(text: Column) -> Column:
    """Different pieces between white space; punctuation stays attached."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != ""))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """0 if either set is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(overlap(a, b) / F.size(F.array_union(a, b)))


def containment(a: Column, b: Column) -> Column:
    """The share of a that is in b; null for an empty a."""
    return F.when(F.size(a) > 0, overlap(a, b) / F.size(a))


def overlap_coefficient(a: Column, b: Column) -> Column:
    """Over the smaller set; 0 if either is empty."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(overlap(a, b) / F.least(F.size(a), F.size(b)))


def stable_hash(token: Column, salt: str = "") -> Column:
    """32 bits of a digest as a long: the same number in any engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), token)), 1, 8), 16, 10).cast("long")


def _character(n: Column) -> Column:
    """A character of its own for each number from 1 up, some million of them."""
    code = F.when(n < 0xD700, n + 0x100).otherwise(n + 0x900)  # surrogates aren't characters
    return F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")


def token_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance between token arrays: each different token of the two becomes a character, and the built-in function takes the strings."""

    def of(kinds: Column) -> Column:
        written = lambda x: F.array_join(F.transform(x, lambda t: _character(F.array_position(kinds, t))), "")
        return F.levenshtein(written(a), written(b))

    return let(F.array_distinct(F.concat(a, b)), of)


def page_confidence(text: Column) -> Column:
    """How much of a page is plain text: 0 for a blank page, else from 0.1 to 0.98 by letters and digits, of any script, among what can be seen, and length."""

    def of(t: Column) -> Column:
        seen = F.length(F.regexp_replace(t, r"[\p{C}\p{Z}]", ""))
        alnum = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]", ""))
        score = 0.45 + 0.35 * alnum / F.greatest(seen, F.lit(1)) + 0.2 * F.least(F.length(t) / 800.0, F.lit(1.0))
        return F.when(t == "", 0.0).otherwise(F.greatest(F.lit(0.1), F.least(F.lit(0.98), score)))

    return let(F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACE}+|{SPACE}+$", ""), of)


def page_class(confidence: Column) -> Column:
    return F.when(confidence < 0.45, "mixed_low_quality").when(confidence < 0.8, "scanned_typed").otherwise("clean_text")


def edit_type(before: Column, after: Column) -> Column:
    """addition, deletion, citation_fix, wording or fact_correction."""
    b, a = F.coalesce(before, F.lit("")), F.coalesce(after, F.lit(""))
    marked = reduce(lambda x, y: x | y, (F.contains(F.lower(b), F.lit(m)) != F.contains(F.lower(a), F.lit(m)) for m in CITATION_MARKS))
    similar = overlap_coefficient(diff_tokens(b), diff_tokens(a)) >= 0.5
    return F.when((b == "") & (a != ""), "addition").when((a == "") & (b != ""), "deletion").when(marked, "citation_fix").when(similar, "wording").otherwise("fact_correction")


def _pieces(pattern: str) -> list[str]:
    """The parts of a pattern at its top level: characters, escapes, classes, groups."""
    out, at = [], 0
    while at < len(pattern):
        end = at + 1
        if pattern[at] == "\\":
            end = at + 2
        elif pattern[at] == "[":
            end = pattern.index("]", at + 1) + 1
        elif pattern[at] == "(":
            depth, end = 1, at + 1
            while depth:
                piece = _pieces(pattern[end : end + 2])[0] if pattern[end] == "\\" else pattern[end : pattern.index("]", end + 1) + 1] if pattern[end] == "[" else pattern[end]
                depth += (piece == "(") - (piece == ")")
                end += len(piece)
        out.append(pattern[at:end])
        at = end
    return out


def needed(pattern: str, least: int = 3) -> list[str] | None:
    """Words of `least` letters or more of which a text that matches the pattern has one at least; None if the pattern doesn't tell. What may be absent, and classes, don't count. Words of under three letters stand only where there are no others."""
    pieces, alternatives = _pieces(pattern), [[]]
    for i, piece in enumerate(pieces):
        if piece == "|":
            alternatives.append([])
        elif piece not in ("?", "*", "+"):
            may_lack = i + 1 < len(pieces) and pieces[i + 1] in ("?", "*", "{")
            alternatives[-1].append("" if may_lack else piece)
    out: list[str] = []
    for one in alternatives:
        runs, inner = [""], []
        for piece in one:
            if len(piece) == 1 and piece.isalpha():
                runs[-1] += piece
                continue
            runs.append("")
            if piece.startswith("(") and not piece.startswith(("(?=", "(?!", "(?<")):
                inner.append(needed(re.sub(r"^\(\?[a-z]*:|^\(", "", piece)[:-1], least))
        longest = max(runs, key=len)
        told = [x for x in ([longest] if len(longest) >= least else None, *inner) if x is not None]
        found = next((x for x in told if min(map(len, x)) > 2), told[0] if told else None)
        if found is None:
            return None
        out += found
    return list(dict.fromkeys(out))


def may_hold(low: Column, pattern: str, words: list[str] | None = None) -> Column | None:
    """Whether a text in lower case has one of the words that the pattern can't do without (words: these, where the pattern doesn't tell); None if it can do without any. Cheap beside a search of the pattern."""
    words = needed(pattern.lower(), 2) if words is None else words
    return None if words is None else reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words))


def holds(text: Column, pattern: str) -> Column:
    """Whether a text in lower case has a match of the pattern, which is taken in lower case too. Words that it can't do without are looked for first, as that is cheap."""
    may, found = may_hold(text, pattern), text.rlike(pattern.lower())
    return found if may is None else may & found


def first_match(text: Column, rules: list[tuple[str, str]], other: str | None) -> Column:
    """The label of the first rule, in order, whose pattern is found in the text, whatever the case: text and patterns are lower-cased once."""

    def of(t: Column) -> Column:
        found = reduce(lambda x, r: x.when(holds(t, r[1]), r[0]), rules[1:], F.when(holds(t, rules[0][1]), rules[0][0]))
        return found if other is None else found.otherwise(other)

    return let(F.lower(F.coalesce(text, F.lit(""))), of)


def first_match_sql(text: str, rules: list[tuple[str, str]], other: str) -> str:
    """The same in SQL."""
    t = f"lower(coalesce({text}, ''))"
    return "CASE " + " ".join(f"WHEN regexp_matches({t}, '{p.lower().replace(chr(39), chr(39) * 2)}') THEN '{name}'" for name, p in rules) + f" ELSE '{other}' END"


def parsed_date(text: Column) -> Column:
    """The first of five formats that fits. A format is tried on texts only that have what it can't do without, as one that doesn't fit costs many times one that does."""

    def tried(t: Column, form: str) -> Column:
        return F.when(t.rlike(_FITS[form]), F.try_to_timestamp(t, F.lit(form)).cast("date"))

    return let(F.regexp_replace(text, r"\s+", " "), lambda t: F.coalesce(*(tried(t, f) for f in DATE_FORMATS)))


#: What a date of each format has: a month's number, of which zeros may come first, or a name of at least as many letters.
_FITS = {"M/d/yyyy": "/", "M-d-yyyy": r"^\+?0*1?[0-9]-", "yyyy-MM-dd": "-", "MMMM d, yyyy": r"(?i)^(?:may|\p{L}{4,}) .*,", "MMM d, yyyy": ","}


def filled(template: str, **holes: Column | str) -> Column:
    """A template with its named holes filled; an absent value leaves its hole empty."""
    out: list[Column] = []
    for before, name, *_ in Formatter().parse(template):
        if before:
            out.append(F.lit(before))
        if name:
            value = holes[name]
            out.append(F.lit(value) if isinstance(value, str) else F.coalesce(value.cast("string"), F.lit("")))
    return F.concat(*out)


def given(template: str, **holes: Column) -> Column:
    """The filled template, or nothing where a value is absent."""
    there = reduce(lambda a, b: a & b, (v.isNotNull() for v in holes.values()))
    return F.when(there, filled(template, **holes))
