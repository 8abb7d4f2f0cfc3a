"""Repeated passages by seed and extend.

Seed: within each window of `length` words the smallest hash of its runs of `SEED_WORDS` words is its anchor, so documents that
share a window share its anchor (winnowing). Anchors found in one document only go no further. An anchor stands for the cell of all
windows that chose it. If all documents agree on a cell, it is a repeat as it is. Extend: else, each document is joined on the anchor with one of the smallest
doc_id, and the match is extended word by word both ways, as far as both cells go; the windows inside are repeats. Windows outside of the match, which
only others than that one document can share, are compared by their hashes. Adjoining windows make the maximal repeats, returned as spans of words.

Words are compared by 64-bit hashes, cells and windows by 128 bits. Each step compares a document with one of the smallest doc_id, found by an
aggregate that is combined before the shuffle, so a passage in a third of all documents costs one row a document and never meets in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_arrow, table, texts
from .words import Hashes, Prefix, hashed, mix

SEED_WORDS = 5
_KEY = ["doc_id", "tag"]


def _window_starts(lengths: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For documents of so many words laid end to end: the windows' starts, and the document of each."""
    ends = np.cumsum(lengths)
    n = np.maximum(lengths - length + 1, 0)
    of = np.repeat(np.arange(len(lengths)), n)
    first = np.cumsum(n) - n
    return np.arange(n.sum()) - first[of] + (ends - lengths)[of], of


def _hashed_batch(batch: pa.RecordBatch, cache: Hashes) -> tuple[np.ndarray, np.ndarray]:
    split = [(t or b"").split() for t in texts(batch)]
    lengths = np.array([len(x) for x in split], np.int64)
    return hashed([w for x in split for w in x], cache), lengths


def _anchors(docs: DataFrame, length: int, positions: bool) -> DataFrame:
    """One row for each anchor: its hash and doc_id, with two hashes of its cell or (positions) the document's tag and the run of windows, as first * 16 + number."""
    cache, width = Hashes(), length - SEED_WORDS + 1

    def run(batch: pa.RecordBatch) -> dict | None:
        h, lengths = _hashed_batch(batch, cache)
        starts, of = _window_starts(lengths, length)
        if not len(starts):
            return None
        prefix = Prefix(h)
        seeds = prefix.windows(SEED_WORDS)
        best, at = seeds[starts], np.zeros(len(starts), np.int64)
        for j in range(1, width):
            x = seeds[starts + j]
            less = x < best
            best[less] = x[less]
            at[less] = j
        chosen = starts + at
        first = np.flatnonzero(np.r_[True, (chosen[1:] != chosen[:-1]) | (of[1:] != of[:-1])])
        n = np.diff(np.r_[first, len(starts)])
        begin, doc = starts[first], of[first]
        anchor = pa.array(best[first].view(np.int64))
        doc_id = batch.column("doc_id").cast(pa.int64()).take(pa.array(doc))
        if not positions:
            cells = [p.runs(begin, begin + n + length - 1) ^ (at[first] * 16 + n).astype(np.uint64) for p in (prefix, Prefix(h, 1))]
            return {"anchor": anchor, "doc_id": doc_id} | {f"cell{i}": pa.array(c.view(np.int64)) for i, c in enumerate(cells)}
        own = begin - (np.cumsum(lengths) - lengths)[doc]
        return {"anchor": anchor, "doc_id": doc_id, "tag": batch.column("tag").take(pa.array(doc)), "run": pa.array(own * 16 + n)}

    return map_arrow(docs, run, "anchor long, doc_id long, " + ("tag int, run long" if positions else "cell0 long, cell1 long"), 512)


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(rows)])


def _matrix(rows: pa.Array, width: int) -> np.ndarray:
    """The matrix again, whatever slice of an array the rows are."""
    offsets = np.frombuffer(rows.buffers()[1], np.int32)[rows.offset :]
    return np.frombuffer(rows.buffers()[2], np.uint8)[offsets[0] : offsets[len(rows)]].view(np.uint64).reshape(-1, width)


def _contexts(found: DataFrame, length: int) -> DataFrame:
    """The cells of the runs listed with each text: anchor, doc_id, tag, run, the number of words left of the anchor, and the hashes of the words left (from it outwards) and right of it."""
    cache, width = Hashes(), length - SEED_WORDS

    def run(batch: pa.RecordBatch) -> dict | None:
        h, lengths = _hashed_batch(batch, cache)
        if not len(h):
            return None
        begin = np.cumsum(lengths) - lengths
        runs = batch.column("runs")
        doc = np.repeat(np.arange(len(lengths)), runs.value_lengths().to_numpy(zero_copy_only=False))
        packed = runs.flatten().to_numpy(zero_copy_only=False)
        start = begin[doc] + packed // 16
        seeds = Prefix(h).windows(SEED_WORDS)
        left, best = np.zeros(len(start), np.int64), seeds[start]
        for j in range(1, width + 1):
            less = seeds[start + j] < best
            best[less] = seeds[start + j][less]
            left[less] = j
        right = packed % 16 + width - 1 - left
        words = np.zeros((len(start), 2 * width), np.uint64)
        for k in range(width):
            for column, some, at in ((k, left > k, start + left - 1 - k), (width + k, right > k, start + left + SEED_WORDS + k)):
                words[some, column] = h[at[some]]
        of = pa.array(doc)
        return {"anchor": pa.array(best.view(np.int64)), "doc_id": batch.column("doc_id").take(of), "tag": batch.column("tag").take(of), "run": pa.array(packed), "left": pa.array(left.astype(np.int32)), "words": _binary(words)}

    return map_arrow(found, run, "anchor long, doc_id long, tag int, run long, left int, words binary", 256)


def _extended(pairs: DataFrame, length: int) -> DataFrame:
    """Of cells (as _contexts gives them) beside the one they are held to (first: doc_id, run, left, words): the run that matches it, if its doc_id is smaller, and each window outside the match with its hash."""
    width = length - SEED_WORDS
    salts = mix(np.arange(1, 4 * width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, 2 * width)

    def run(batch: pa.RecordBatch) -> dict | None:
        first = batch.column("first")
        names = [f.name for f in first.type]
        other = dict(zip(names, first.flatten(), strict=True))

        own, theirs = (_matrix(x, 2 * width) for x in (batch.column("words"), other["words"]))
        doc_id, packed, left = (batch.column(c).to_numpy() for c in ("doc_id", "run", "left"))
        least, packed2, left2 = (other[c].to_numpy(zero_copy_only=False) for c in ("doc_id", "run", "left"))
        n, right, right2 = packed % 16, packed % 16 + width - 1 - left, packed2 % 16 + width - 1 - left2
        same = own == theirs
        reach = np.minimum(np.minimum(left, left2), np.cumprod(same[:, :width], axis=1).sum(axis=1))
        reach2 = np.minimum(np.minimum(right, right2), np.cumprod(same[:, width:], axis=1).sum(axis=1))
        found = np.maximum(0, reach + reach2 + SEED_WORDS - length + 1)
        at = np.flatnonzero((found > 0) & (doc_id > least))
        runs = (packed[at] // 16 + left[at] - reach[at]) * 16 + found[at]
        # windows outside the match
        of = np.repeat(np.arange(len(n)), n)
        offset = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        outside = (offset < (left - reach)[of]) | (offset >= (left - reach + found)[of])
        of, offset = of[outside], offset[outside]
        rows, place = np.unique(of, return_inverse=True)
        anchor = batch.column("anchor").to_numpy().view(np.uint64)[of]
        hashes = []
        for salt in salts:
            mixed = mix(own[rows] ^ salt)
            sums = [np.concatenate([np.zeros((len(rows), 1), np.uint64), np.cumsum(x, axis=1, dtype=np.uint64)], axis=1) for x in (mixed[:, :width], mixed[:, width:])]
            before = left[of] - offset
            hashes.append(mix(anchor * salt[0] + sums[0][place, before] * np.uint64(3) + sums[1][place, width - before] + before.astype(np.uint64)).view(np.int64))
        both = pa.array(np.r_[at, of])
        none = pa.nulls(len(at), pa.int64())
        return {
            "w0": pa.concat_arrays([none, pa.array(hashes[0])]),
            "w1": pa.concat_arrays([none, pa.array(hashes[1])]),
            "doc_id": batch.column("doc_id").take(both),
            "tag": batch.column("tag").take(both),
            "run": pa.array(np.r_[runs, (packed[of] // 16 + offset) * 16 + 1]),
        }

    return map_arrow(pairs, run, "w0 long, w1 long, doc_id long, tag int, run long", 1 << 16)


def _spans(runs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal spans of words under runs of windows; spans that touch are one."""
    runs = np.sort(runs)
    start, end = runs // 16, runs // 16 + runs % 16 + length - 1
    reach = np.maximum.accumulate(end)
    new = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]]) if len(start) else np.zeros(0, np.int64)
    return start[new], reach[np.r_[new[1:] - 1, len(start) - 1]] if len(start) else reach


def repeats(docs: DataFrame, length: int = 13) -> DataFrame:
    """doc_id, tag, runs: for each document with repeats, its windows of `length` words that also start in a document of smaller doc_id.

    docs: doc_id, text, and tag, an int that tells rows of one doc_id apart. length: 13 to SEED_WORDS + 15 words.
    """
    if not SEED_WORDS <= length < SEED_WORDS + 15:
        raise ValueError(f"length: {SEED_WORDS} to {SEED_WORDS + 14}")
    agreed = (F.min("cell0") == F.max("cell0")) & (F.min("cell1") == F.max("cell1"))
    agg = _anchors(docs.select("doc_id", "text"), length, False).groupBy("anchor").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), agreed.alias("agreed"))
    shared = cut(agg.where("least < most").select("anchor", "least", "agreed"), "anchors")
    seen = cut(_anchors(docs, length, True).join(shared, "anchor").where("not agreed or doc_id > least").select("doc_id", "tag", "run", "agreed"), "seeds")
    listed = seen.where("not agreed").groupBy(*_KEY).agg(F.collect_list("run").alias("runs"))
    cells = cut(_contexts(docs.join(listed, _KEY).select("doc_id", "tag", "text", "runs"), length), "cells")
    # tables of their own leave the joins free to split a common anchor or window
    first = cut(cells.groupBy("anchor").agg(F.min_by(F.struct("doc_id", "run", "left", "words"), F.struct("doc_id", "tag", "run")).alias("first")), "first-cells")
    held = cut(_extended(cells.join(first, "anchor"), length), "extended")
    windows = held.where("w0 is not null")
    least = cut(windows.groupBy("w0", "w1").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("w0", "w1", "least"), "shared-windows")
    repeated = windows.join(least, ["w0", "w1"]).where("doc_id > least").select("doc_id", "tag", "run")
    matched = held.where("w0 is null").select("doc_id", "tag", "run")
    return seen.where("agreed").select("doc_id", "tag", "run").unionByName(matched).unionByName(repeated).groupBy(*_KEY).agg(F.collect_list("run").alias("runs"))


def remove_repeats(docs: DataFrame, length: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words joined by one space), spans (of the removed words: start, end).

    A word goes if a window of `length` words over it also starts in a document of smaller doc_id. docs needs doc_id and
    text. Null texts have no words. Rows without doc_id lose nothing and take nothing from others; rows that
    repeat a doc_id are each judged against smaller doc_ids only. Empty table: no rows.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.hash("text"), F.lit(0)).alias("tag"))
    known = base.where("doc_id is not null")
    found = known.join(cut(repeats(known, length), "repeats"), _KEY, "left").select("doc_id", "text", "runs")
    everything = found.unionByName(base.where("doc_id is null").select("doc_id", "text", F.lit(None).cast("array<bigint>").alias("runs")))

    def run(batch: pa.RecordBatch) -> dict:
        out: dict = {"doc_id": batch.column("doc_id"), "n_words": [], "n_removed": [], "kept": [], "spans": []}
        for t, runs in zip(texts(batch), batch.column("runs"), strict=True):
            words = (t or b"").split()
            start, end = _spans(runs.values.to_numpy(zero_copy_only=False), length) if runs.is_valid else ((), ())
            kept, at = [], 0
            for a, b in zip(start, end, strict=True):
                kept += words[at:a]
                at = b
            kept += words[at:]
            out["n_words"].append(len(words))
            out["n_removed"].append(len(words) - len(kept))
            out["kept"].append(b" ".join(kept).decode())
            out["spans"].append([{"start": int(a), "end": int(b)} for a, b in zip(start, end, strict=True)])
        return out

    return map_arrow(everything, run, "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:int,end:int>>", 512)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """remove_repeats of windows of 13 words from documents, with the SHA-256 of the kept words."""
    out = remove_repeats(table(spark, sf_dir, "documents"), 13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []::VARCHAR[]) AS words FROM documents),
g AS (SELECT doc_id, i, array_to_string(words[i : i + 12], ' ') AS window_text FROM w, unnest(generate_series(1, len(words) - 12)) AS t(i)),
m AS (SELECT window_text, min(doc_id) AS least FROM g GROUP BY window_text HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT DISTINCT g.doc_id, g.i + k AS j FROM g JOIN m USING (window_text), unnest(generate_series(0, 12)) AS t(k) WHERE g.doc_id > m.least),
gone AS (SELECT doc_id, list(j) AS js FROM hit GROUP BY doc_id),
kept AS (SELECT w.doc_id, len(words) AS n_words, coalesce(len(js), 0) AS n_removed,
  list_transform(list_filter(generate_series(1, len(words)), lambda i: js IS NULL OR NOT list_contains(js, i)), lambda i: words[i]) AS k
  FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM kept
"""
