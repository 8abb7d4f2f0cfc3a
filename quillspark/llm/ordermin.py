"""Order MinHash fingerprints: near 1 for texts at a small edit distance, and told apart by order, not by content alone.

A text is a sequence of units, the same in all texts: each character of a script that is written without spaces between words, and each run of
other characters between these and white space. Its k-mers are numbered by occurrence. Under each of `sketches` hash orders the `tuple_size` smallest numbered
k-mers are taken in the order of the text, and their hash is one component of the fingerprint.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import map_arrow, table, texts
from .words import Hashes, Prefix, hashed, mix

#: Fixed values of Unicode: Thai and Lao, Myanmar, Khmer, kana, ideographs and their extensions.
ALONE = r"\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_ALONE = re.compile(f"[{ALONE}]")
_UNIT = re.compile(rf"[{ALONE}]|[^\x20\x09-\x0D{ALONE}]+")
_MOST = np.uint64((1 << 64) - 1)
_BLOCK = 1 << 18


def units(text: str) -> list[bytes]:
    if text.isascii() or not _ALONE.search(text):
        return text.encode().split()  # the same, faster
    return [u.encode() for u in _UNIT.findall(text)]


class Fingerprinter:
    def __init__(self, sketches: int = 64, k: int = 2, tuple_size: int = 2):
        seeds = mix(np.arange(1, 2 * sketches + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.xors, self.odds = seeds[:sketches, None], seeds[sketches:, None] | np.uint64(1)
        self.sketches, self.k, self.tuple_size, self.cache = sketches, k, tuple_size, Hashes()

    def __call__(self, text: str) -> np.ndarray:
        """32-bit components. A text of fewer than k units is one k-mer; without units all components are 0."""
        h = hashed(units(text), self.cache)
        if not len(h):
            return np.zeros(self.sketches, np.uint32)
        kmers = Prefix(h).windows(min(self.k, len(h)))
        order = np.argsort(kmers, kind="stable")
        run = kmers[order]
        first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        nth = np.empty(len(kmers), np.uint64)
        nth[order] = np.arange(len(kmers)) - np.repeat(first, np.diff(np.r_[first, len(kmers)]))
        numbered = mix(kmers + nth * np.uint64(0xD6E8FEB86659FD93))
        out, step = np.empty(self.sketches, np.uint64), max(1, _BLOCK // len(kmers))
        for a in range(0, self.sketches, step):
            orders = (numbered ^ self.xors[a : a + step]) * self.odds[a : a + step]
            rows, at = np.arange(len(orders)), []
            for _ in range(min(self.tuple_size, len(kmers))):
                at.append(orders.argmin(axis=1))
                orders[rows, at[-1]] = _MOST
            chosen = np.sort(np.stack(at), axis=0)
            total = np.zeros(len(orders), np.uint64)
            for i in chosen:
                total = mix(total * np.uint64(0xA24BAED4963EE407) + kmers[i])
            out[a : a + step] = total
        return (out >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def fingerprints(docs: DataFrame, **how: int) -> DataFrame:
    """doc_id, fingerprint (hexadecimal) of each text; null texts count as empty, and have the fingerprint of texts without units: zeros.

    docs needs doc_id and text; a null doc_id stays null, repeated rows come out alike, other columns aren't read. Empty table: no rows.
    """
    made = Fingerprinter(**how)

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id").cast(pa.int64()), "fingerprint": [made((t or b"").decode()).tobytes().hex() for t in texts(batch)]}

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, fingerprint string")


class Cells:
    """Ranges of (place, tag) in order. A place that several quantiles fall on has as many cells of its own, by its tags, which are hashes."""

    def __init__(self, quantiles: list[int]):
        found, times = np.unique(np.array(quantiles, np.int64), return_counts=True)
        hot = found[times > 1]
        self.bounds = np.unique(np.r_[found, hot[hot < np.iinfo(np.int64).max] + 1])
        inside = np.r_[1, np.ones(len(self.bounds), np.int64)]  # cells in the range from a bound on
        inside[np.searchsorted(self.bounds, hot, side="right")] = times[times > 1]
        self.inside, self.first = inside, np.cumsum(inside) - inside

    def __call__(self, place: np.ndarray, tag: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.bounds, place, side="right")
        return (self.first[at] + ((tag >> 31) * self.inside[at] >> 32)).astype(np.int32)


def with_next(docs: DataFrame, f, schema: str) -> DataFrame:
    """f(doc_id, text, next text) for each document and the next by ascending doc_id, after the last the first.

    Documents are dealt out by ranges of doc_id; the first of each range also goes, once more, to the end of the range
    before. Texts travel compressed, once. Rows that share a doc_id follow one another by text hash, and are dealt out by it where they are many; a null doc_id
    comes first. f returns a row in schema's order.
    """
    spark = docs.sparkSession
    tag = F.xxhash64("text").bitwiseAND(F.lit((1 << 63) - 1))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("place", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("tag", tag)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + (docs.select(F.spark_partition_id().alias("part")).agg(F.max("part")).first()[0] or 0))
    number = 4 * parts
    cells = Cells(base.agg(F.percentile_approx("place", [i / number for i in range(1, number)], 20 * number).alias("q")).first()["q"] or [])

    def cells_only(batch: pa.RecordBatch) -> dict:
        place, tag = (batch.column(c).to_numpy() for c in ("place", "tag"))
        cell = cells(place, tag)
        by = np.lexsort((tag, place, cell))
        first = by[np.flatnonzero(np.r_[True, np.diff(cell[by]) != 0])] if len(by) else by
        return {"cell": cell[first], "place": place[first], "tag": tag[first]}

    lowest = map_arrow(base.select("place", "tag"), cells_only, "cell int, place long, tag long").groupBy("cell").agg(F.min(F.struct("place", "tag")).alias("head")).collect()  # a row a cell
    heads = {r["cell"]: tuple(r["head"]) for r in lowest}
    order = sorted(heads)
    before = {c: order[i - 1] for i, c in enumerate(order)}  # the first cell's is the last

    def deal(batch: pa.RecordBatch) -> dict:
        pack = zstandard.ZstdCompressor(level=1).compress
        place, tag = (batch.column(c).to_numpy() for c in ("place", "tag"))
        cell = cells(place, tag)
        # rows that repeat a head are one
        extra = list({c: i for i, (c, p) in enumerate(zip(cell.tolist(), zip(place.tolist(), tag.tolist(), strict=True), strict=True)) if heads[c] == p}.values())
        at = np.r_[np.arange(len(cell)), np.array(extra, np.int64)]
        packed = [pack(t) for t in texts(batch)]
        return {
            "cell": np.r_[cell, [before[cell[i]] for i in extra]].astype(np.int32),
            "head": np.r_[np.zeros(len(cell), bool), np.ones(len(extra), bool)],
            "place": place[at],
            "tag": tag[at],
            "doc_id": batch.column("doc_id").take(pa.array(at)),
            "packed": [packed[i] for i in at.tolist()],
        }

    dealt = map_arrow(base, deal, "cell int, head boolean, place long, tag long, doc_id long, packed binary", 512)
    sorted_ = dealt.repartition(parts, "cell").sortWithinPartitions("cell", "head", "place", "tag")
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        last: tuple | None = None  # cell, doc_id, text of the document that waits for its next
        done: list[tuple] = []
        for batch in batches:
            for cell, head, doc_id, packed in zip(*(batch.column(c) for c in ("cell", "head", "doc_id", "packed")), strict=True):
                cell, head, text = cell.as_py(), head.as_py(), unpack(packed.as_py()).decode()
                if last is not None and last[0] == cell:
                    done.append(f(last[1], last[2], text))
                last = None if head else (cell, doc_id.as_py(), text)
                if len(done) >= 256:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*done, strict=True), arrow, strict=True)], schema=arrow)
                    done = []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*done, strict=True), arrow, strict=True)], schema=arrow)

    return sorted_.mapInArrow(run, schema)


def edited_likeness(docs: DataFrame, **how: int) -> DataFrame:
    """Each text's fingerprint beside that of its edited text and of the next document.

    The edited text has its last floor(n / 2) characters replaced by as many first ones of the next text, or by all of a
    shorter one. docs needs doc_id and text, and other columns aren't read; null texts count as empty. Rows with one doc_id, or none (these come first), follow one
    another by a hash of the text, repeated rows included. Empty table: no rows. One document: it is its own next.
    """
    made = Fingerprinter(**how)
    kept: dict[str, np.ndarray] = {}

    def of(text: str) -> np.ndarray:
        return kept[text] if text in kept else made(text)

    def row(doc_id: int | None, text: str, after: str) -> tuple:
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, next_, changed = of(text), of(after), made(edited)
        kept.clear()
        kept[after] = next_
        return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), own.tobytes().hex(), changed.tobytes().hex(), likeness(own, changed), likeness(own, next_)

    return with_next(docs, row, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op6_order_min_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edited_likeness of each row of documents."""
    return edited_likeness(table(spark, sf_dir, "documents"))
