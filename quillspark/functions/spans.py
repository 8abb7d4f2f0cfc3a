"""Places of matches: SQL's functions tell texts only, the pieces between matches tell where they were."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

RUN = 256
MATCHES = "array<struct<start:int,end:int,match:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], out: str) -> Column:
    """All that step(state, item) puts out, an array each, while the state goes from item to item; out: the type of it all.

    Items are taken in runs whose outputs are joined at the end: an array that grows by one is copied as a whole each time.
    """
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(items) / RUN).cast("int") - 1, F.lit(0))), lambda i: F.slice(items, i * RUN + 1, RUN))

    def one(acc: Column, item: Column) -> Column:
        after, put = step(acc["state"], item)
        return F.struct(after.alias("state"), F.concat(acc["out"], put).alias("out"))

    def run(acc: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(acc["state"].alias("state"), F.array().cast(out).alias("out")), one)
        return let(done, lambda x: F.struct(x["state"].alias("state"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

    return F.flatten(F.aggregate(runs, F.struct(state.alias("state"), F.array().cast(f"array<{out}>").alias("out")), run, lambda acc: acc["out"]))


#: Stands between matches while a text is taken apart; texts that hold it go the longer way.
MARK = "\x01"


def match_spans(text: Column, pattern: str) -> Column:
    """array of (start, end, match) of the leftmost matches that don't overlap, in code points; empty for null. The pattern is searched once, in time linear in the text."""

    def placed(pieces: Column) -> Column:
        """pieces: what is before a match and the match by turns, and at last what is after them."""

        def step(at: Column, i: Column) -> tuple[Column, Column]:
            start = at + F.length(F.get(pieces, i * 2))
            end = start + F.length(F.get(pieces, i * 2 + 1))
            return end, F.array(F.struct(start.alias("start"), end.alias("end"), F.get(pieces, i * 2 + 1).alias("match")))

        return F.when(F.size(pieces) > 1, scan(F.sequence(F.lit(0), F.floor(F.size(pieces) / 2).cast("int") - 1), F.lit(0), step, MATCHES)).otherwise(F.array().cast(MATCHES))

    def of(t: Column) -> Column:
        between = lambda: F.split(t, pattern, -1)
        twice = let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda x: F.flatten(F.zip_with(between(), x, lambda a, m: F.array_compact(F.array(a, m)))))
        once = F.split(F.regexp_replace(t, pattern, f"{MARK}$0{MARK}"), MARK, -1)
        return let(F.when(F.contains(t, F.lit(MARK)), twice).otherwise(once), placed)

    return let(F.coalesce(text, F.lit("")), of)


def first_span(text: Column, pattern: str) -> Column:
    """(start, end, match) of the first match, in code points; null without any. For patterns that match more than nothing.

    A pattern that looks at nothing beyond its match would match wherever the match's text stands, so the first place of that is where it was; others are searched again.
    """
    own = not re.search(r"\\[bBAGzZ]|[$]|(?<!\[)\^|\(\?(?!:|i[a-z]*\)|=\[)", pattern.replace("\\$", ""))

    def of(m: Column) -> Column:
        start = F.instr(text, m) - 1 if own else F.length(F.get(F.split(text, pattern, 2), F.lit(0)))
        return F.when(m != "", let(start, lambda s: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("match"))))

    return let(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 0), of)


BLOCK = 1024


def blocks(text: Column) -> Column:
    """The text in pieces of BLOCK characters, out of which any part is cut without a walk from the text's start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def between(pieces: Column, start: Column, end: Column) -> Column:
    """The characters from start up to end, out of the blocks of a text."""
    i, j = F.floor(start / BLOCK).cast("int"), F.floor((end - 1) / BLOCK).cast("int")
    return F.when(end <= start, F.lit("")).otherwise(F.substring(F.array_join(F.slice(pieces, i + 1, j - i + 1), ""), (start - i * BLOCK + 1).cast("int"), (end - start).cast("int")))


def around(pieces: Column, start: Column, end: Column, before: int, after: int) -> Column:
    """What stands from `before` characters left of a span to `after` right of it, out of the blocks of a text."""
    return between(pieces, F.greatest(start - before, F.lit(0)), end + after)


def first_by(items: Column, key: Callable[[Column], Column]) -> Column:
    """The items of an array whose key comes for the first time, in order: keys are sorted with their places, and the first of each stays."""

    def of(x: Column) -> Column:
        keyed = F.array_sort(F.transform(x, lambda item, i: F.struct(key(item).alias("key"), i.alias("i"))))
        heads = let(keyed, lambda k: F.filter(k, lambda s, i: (i == 0) | ~s["key"].eqNullSafe(F.get(k, i - 1)["key"])))
        return F.transform(F.array_sort(F.transform(heads, lambda s: s["i"])), lambda i: F.get(x, i))

    return let(items, of)


def last_before(marks: Column, starts: Column, none: int = 1) -> Column:
    """For each of the starts, in order, the number of the last of marks (end, number) that ends by it; `none` without any. Both are merged in one pass."""
    events = F.concat(
        F.transform(marks, lambda m: F.struct(m["end"].cast("int").alias("at"), F.lit(0).alias("start"), F.lit(-1).alias("i"), m["number"].cast("int").alias("number"))),
        F.transform(starts, lambda s, i: F.struct(s.cast("int").alias("at"), F.lit(1).alias("start"), i.alias("i"), F.lit(None).cast("int").alias("number"))),
    )
    found = "array<struct<i:int,number:int>>"

    def step(last: Column, e: Column) -> tuple[Column, Column]:
        own = e["start"] == 0
        return F.when(own, e["number"]).otherwise(last), F.when(own, F.array().cast(found)).otherwise(F.array(F.struct(e["i"].alias("i"), last.alias("number"))))

    return F.transform(F.array_sort(let(F.array_sort(events), lambda x: scan(x, F.lit(none), step, found))), lambda x: x["number"])


def numbered(text: Column, pattern: str) -> Column:
    """array of (end, number): the matches of a pattern whose first group is a number."""
    return F.transform(match_spans(text, pattern), lambda m: F.struct(m["end"].alias("end"), F.regexp_extract(m["match"], pattern, 1).cast("int").alias("number")))
