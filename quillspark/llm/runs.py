"""Periodic runs of words: all maximal repetitions of a text, and the text without what repeats.

The texts of a batch are one sequence of numbers, in which no two texts have a number in common, so all of them are indexed at once. Prefix doubling sorts the
suffixes; the ranks it passes through say whether two blocks of 2^k words are equal, so the common extension of any two places, to the right or to the left, takes a comparison
a level. Suffix array and LCP array give each place's longest previous factor, and those the Lempel-Ziv blocks of a text.

A run that touches the border of two blocks has a period shorter than both together (a block that starts a period or more into a run reaches the run's end), so Main's
extensions of each border, both ways and for each such period, find it. A run inside of a block, neighbours included, stands in the block's earlier occurrence too: it's copied
from there, block by block from left to right, out of buckets of the runs by their starts.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import ship, table, texts

_BATCH, _STEP = 1 << 16, 1 << 20
Run = tuple[int, int, int]  # start, length, period


class Index:
    """Suffixes of a sequence of texts, sorted; tokens of different texts differ. At(n) and before place 0 there's nothing."""

    def __init__(self, tokens: np.ndarray, ends: np.ndarray):
        """ends: for each place, the end of its text."""
        n = len(tokens)
        self.n = n
        order = np.argsort(tokens, kind="stable")
        rank = self._ranks(np.zeros(n, np.int64), order, tokens)
        self.levels = [np.r_[rank, -1].astype(np.int32)]
        active, width = self._tied(rank, np.arange(n)), 1
        while len(active):
            next_ = active + width
            second = np.where(next_ < ends[active], rank[np.minimum(next_, n - 1)] + 1, 0)
            key = rank[active] * (n + 1) + second
            by = np.argsort(key, kind="stable")
            active = active[by]
            rank[active] = self._ranks(rank[active], np.arange(len(active)), key[by])
            self.levels.append(np.r_[rank, -1].astype(np.int32))
            active, width = self._tied(rank, active), width * 2
        self.suffixes = np.empty(n, np.int64)
        self.suffixes[rank] = np.arange(n)
        self.lcp = np.zeros(n, np.int64)
        self.lcp[1:] = self.right(self.suffixes[:-1], self.suffixes[1:])

    @staticmethod
    def _ranks(old: np.ndarray, order: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Ranks by key within groups of one old rank, which is where the group starts; key and old are sorted by `order`."""
        k, o, at = key[order], old[order], np.arange(len(order))
        first = lambda x: np.maximum.accumulate(np.where(np.r_[True, x[1:] != x[:-1]], at, 0)) if len(x) else at
        out = np.empty(len(order), np.int64)
        out[order] = o + first(k) - first(o)
        return out

    @staticmethod
    def _tied(rank: np.ndarray, active: np.ndarray) -> np.ndarray:
        """Those of the active places that share their rank with another."""
        times = np.bincount(rank[active], minlength=len(rank))
        return active[times[rank[active]] > 1]

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a on equal those from b on (a < b or b < a, never equal)."""
        x, y = a.copy(), b.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            r = self.levels[k]
            step = (r[x] == r[y]).astype(np.int64) << k
            x += step
            y += step
        return x - a

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before a equal those before b (a < b)."""
        x, y = a.copy(), b.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            r, back = self.levels[k], x - (1 << k)
            step = ((back >= 0) & (r[np.maximum(back, 0)] == r[np.maximum(y - (1 << k), 0)])).astype(np.int64) << k
            x -= step
            y -= step
        return a - x


def previous_factors(suffixes: list[int], lcp: list[int], first: int) -> tuple[list[int], list[int]]:
    """For each place of one text: the length of its longest factor that also starts earlier, and where (-1: none). lcp[i] is that of suffixes i-1 and i; one pass with a stack."""
    n = len(suffixes)
    length, source = [0] * n, [-1] * n
    stack: list[tuple[int, int]] = []  # place, and what it has in common with the one below it
    for s, common in [*zip(suffixes, [0, *lcp[1:]], strict=True), (-1, 0)]:
        while stack and s < stack[-1][0]:
            place, below = stack.pop()
            if below >= common:
                length[place - first], source[place - first] = below, stack[-1][0] if below else -1
            else:
                length[place - first], source[place - first] = common, s
            common = min(common, below)
        stack.append((s, common))
    for (place, below), under in zip(stack[1:], stack, strict=False):
        if place >= 0 and under[0] >= 0 and below:
            length[place - first], source[place - first] = below, under[0]
    return length, source


def blocks(length: list[int]) -> list[int]:
    """Starts of the Lempel-Ziv blocks, and the end of the text."""
    at, out = 0, [0]
    while at < len(length):
        at += length[at] or 1
        out.append(at)
    return out


def _borders(index: Index, first: int, starts: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """start, end and period of the repetitions that touch borders, by Main's extensions: with a period to the right of the border, and with one to its left."""
    c, size = starts[:-1], np.diff(starts)
    end = starts[-1]
    prev, word = np.r_[0, size[:-1]], index.levels[0]
    for shift, most in ((0, size), (1, prev + size - 1)):
        total = np.r_[0, np.cumsum(most)]
        for a in range(0, int(total[-1]), _STEP):
            i = np.arange(a, min(a + _STEP, int(total[-1])))
            at = np.searchsorted(total, i, side="right") - 1
            q = i - total[at] + 1
            x = c[at] - q * shift
            y = x + q
            fits = (x >= 0) & (y < end)
            x, y, q = x[fits] + first, y[fits] + first, q[fits]
            some = (word[x] == word[y]) | (word[x - 1] == word[y - 1])  # most borders extend neither way
            x, y, q = x[some], y[some], q[some]
            forth = index.right(x, y)
            back = np.where(x > first, index.left(x, y), 0)
            ok = forth + back >= np.maximum(q, least - q)
            yield x[ok] - back[ok], y[ok] + forth[ok], q[ok]
    # a run that ends with the text touches its last border: periods to the left of it
    q = np.arange(1, int(size[-1]) // 2 + 1)
    x, y = end - q + first, np.full(len(q), end + first)
    back = index.left(x, y)
    ok = back >= np.maximum(q, least - q)
    yield x[ok] - back[ok], y[ok], q[ok]


def _copied(found: dict[int, dict[int, int]], starts: list[int], length: list[int], source: list[int], least: int) -> None:
    """Adds the runs that lie inside of blocks; found: start to end to period."""
    for b, e in zip(starts, starts[1:], strict=False):
        if e - b < least + 2 or length[b] < e - b:
            continue
        away = b - source[b]
        for i in range(source[b] + 1, e - away - least):
            for j, q in list(found.get(i, {}).items()):
                if j < e - away:
                    found.setdefault(i + away, {})[j + away] = q


def runs_of(index: Index, first: int, end: int, least: int) -> list[Run]:
    """The runs of the text that stands from first up to end, by start and period, each with its smallest period; starts count from its first word."""
    lcp = index.lcp[first:end].copy()
    lcp[:1] = 0
    # words q apart are equal over a run's length less q, which is half of it at least
    if end - first < least or lcp.max() < least - least // 2:
        return []
    length, source = previous_factors(index.suffixes[first:end].tolist(), lcp.tolist(), first)
    source = [s - first if s >= 0 else s for s in source]
    starts = blocks(length)
    found: dict[int, dict[int, int]] = {}
    for a, b, q in _borders(index, first, np.array(starts), least):
        for i, j, p in zip((a - first).tolist(), (b - first).tolist(), q.tolist(), strict=True):
            ends = found.setdefault(i, {})
            ends[j] = min(p, ends.get(j, p))
    if found:
        _copied(found, starts, length, source, least)
    return sorted(((i, j - i, p) for i, ends in found.items() for j, p in ends.items()), key=lambda r: (r[0], r[2]))


def find_runs(documents: list[list], least: int = 12) -> list[list[Run]]:
    """For each sequence of words its runs of length max(least, 2 * period) and more, by start and period."""
    names: dict = {}
    sizes = np.array([len(w) for w in documents], np.int64)
    n = int(sizes.sum())
    if not n:
        return [[] for _ in documents]
    ids = np.fromiter((names.setdefault(w, len(names)) for w in chain.from_iterable(documents)), np.int64, n)
    ends = np.cumsum(sizes)
    index = Index(ids + np.repeat(np.arange(len(documents)), sizes) * len(names), np.repeat(ends, sizes))
    return [runs_of(index, int(e - s), int(e), least) for s, e in zip(sizes, ends, strict=True)]


def kept(words: list, runs: list[Run]) -> list:
    """The words that no run contains after its first period."""
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g] if runs else words


def _row(words: list[bytes], runs: list[Run]) -> tuple:
    start, length, period = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    listed = "".join(f"{a},{n},{p}\n" for a, n, p in runs)
    return (
        len(runs), start, length, period, 1000 * length // period if period else None,
        hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept(words, runs))).hexdigest(),
    )


FACTS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _over_words(docs: DataFrame, make: Callable[[list[bytes], list[Run]], tuple], schema: str, least: int, change: Callable[[int | None, list[bytes]], list[bytes]] | None) -> DataFrame:
    """make(words, runs) of each text after its doc_id. Texts are taken together up to a number of words, and longer ones each by itself."""
    ship(docs.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(f"doc_id long, {schema}"))

    def done(ids: list, words: list[list[bytes]]) -> pa.RecordBatch:
        rows = [(i, *make(w, r)) for i, w, r in zip(ids, words, find_runs(words, least), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        words: list[list[bytes]] = []
        held = 0
        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                w = (t or b"").split()
                w = change(i, w) if change else w
                if held and held + len(w) > _BATCH:
                    yield done(ids, words)
                    ids, words, held = [], [], 0
                ids.append(i)
                words.append(w)
                held += len(w)
        if ids:
            yield done(ids, words)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, f"doc_id long, {schema}")


def periodic_runs(docs: DataFrame, least: int = 12, change: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, the number of runs, the longest one (ties: smallest start, then period) and digests of all runs and of the words that are left without their repetitions.

    A run is a stretch of words with a smallest period q, at least max(least, 2 * q) long, that no neighbour extends. Words are what stands between ASCII white space, compared by their bytes.
    change(doc_id, words), if given, is what is searched instead of a text's words. docs needs doc_id and text; other columns aren't read, whatever their names. Null, empty and blank texts have no words and no runs, and
    nulls for the longest. A null doc_id stays null; repeated rows come out alike; rows that share a doc_id are each searched by themselves. Very long texts are searched whole, in memory of about
    20 bytes a word and level of the longest repeat's logarithm. Empty table: no rows.
    """
    return _over_words(docs, _row, FACTS, least, change)


def collapse(docs: DataFrame, least: int = 12) -> DataFrame:
    """doc_id, runs (an array of start, length, period), text without the words that repeat a run's first period, joined by one space. Odd input as in periodic_runs; a null text gives an empty one."""

    def made(words: list[bytes], runs: list[Run]) -> tuple:
        return [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], b" ".join(kept(words, runs)).decode()

    return _over_words(docs, made, "runs array<struct<start:long,length:long,period:long>>, text string", least, None)


def with_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The registered query's change of every tenth document, by its hash: from some word on it repeats a number of words. A null doc_id changes nothing."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    once = words[a : a + p]
    return words[:a] + (once * ((n - a) // p + 1))[: n - a]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """periodic_runs of each row of documents, whose words with_period changes."""
    return periodic_runs(table(spark, sf_dir, "documents"), change=with_period)
