"""Near-duplicates at a similarity: SimHash blocks first, and an exact join of the texts' sets of shingles by their rarest ones for what these leave.

Texts are compared as sets of different shingles; texts of one set are compared once. Sets whose SimHash differs in a few bits meet in pigeonhole blocks
and are held to the similarity; but at a similarity of 0.8 fingerprints differ in ten bits of 64 and more, which no blocks can find, so a join follows.
All sets are put into one order, from rare shingles to frequent ones. If the first shingle that two sets have in common stands at place i of a set of n, at most
n - i are common: what partners are then large and small enough follows, and past some place there are none. So a set is looked up by a few of its
rarest shingles only, its keys, and every pair at the similarity meets under one. Any order gives the same pairs; how rare a shingle is may thus be counted by buckets of hashes.

Families of near copies meet under the same keys, so their pairs aren't listed. Each set is first held to one member of each of its keys, the
one that has fewest rarer shingles and so is nearest to what the family has in common; what that joins up is one component. Then members of
different components only are compared, those outside a key's most common component with all of it. Before sets themselves
are compared, the parities of the numbers of shingles by bucket must not differ in more buckets than two sets at the similarity can differ in shingles; the last join holds
that in its condition. A family whose members are all less alike than the similarity so costs comparisons of a few words each, as many as it has pairs under its rarest common shingles, but no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, ship, texts
from .simhash import components, links, shingles

BUCKETS, CHUNKS = 1 << 20, 64
PARITY = 512
_WORDS = [f"p{i}" for i in range(PARITY // 64)]


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """The hashes of the different shingles of a text, ascending."""
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, set(shingles(text, size))), np.uint64))


def _counts(docs: DataFrame, size: int) -> np.ndarray:
    """How many shingles fall into each bucket of hashes."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for t in texts(batch):
                np.add.at(total, (shingle_set(t, size) % np.uint64(BUCKETS)).astype(np.int64), 1)
        if total.any():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(range(CHUNKS), pa.int32()), "counts": pa.array([x.tobytes() for x in total.astype("<u4").reshape(CHUNKS, -1)], pa.binary())})

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS // CHUNKS, np.int64)
        for batch in batches:
            for x in batch.column("counts"):
                total += np.frombuffer(x.as_py(), "<u4")
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([np.minimum(total, 2**32 - 1).astype("<u4").tobytes()], pa.binary())})

    found = docs.select("text").mapInArrow(count, "chunk int, counts binary").groupBy("chunk").applyInArrow(add, "chunk int, counts binary").collect()  # 4 bytes a bucket
    return np.concatenate([np.frombuffer(r["counts"], "<u4") for r in sorted(found, key=lambda r: r["chunk"])]) if found else np.zeros(BUCKETS, "<u4")


def simhash(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; none: 0."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        total += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<i8")[0])


def parities(hashes: np.ndarray) -> np.ndarray:
    """Whether the number of hashes in each of PARITY buckets is odd. Two sets that differ in d hashes differ in at most d of these bits."""
    odd = np.bincount((hashes >> np.uint64(32)).astype(np.int64) % PARITY, minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _sides(rows: DataFrame, end: str, *keep: str) -> DataFrame:
    return rows.select(*keep, *(F.col(c).alias(f"{c}_{end}") for c in rows.columns if c not in keep))


def near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8, bits: int = 2) -> DataFrame:
    """doc_id, text_hash, component_id, component: the smallest doc_id reachable over links between documents whose shingles are similar, itself included; text_hash (xxhash64 of the text) tells rows
    of one doc_id apart, component (a number of this run) components that share a doc_id.

    docs needs doc_id and text; other columns aren't read. Null and empty texts are copies of one another. A null doc_id has the component of its text, which is null if no other has one.
    Repeated rows are all returned. Pairs at just the similarity are linked. Very long texts count whole. Empty table: no rows. Shingles are compared by 64-bit hashes, sets taken for equal by 128 bits.
    """
    counts = docs.sparkSession.sparkContext.broadcast(_counts(docs, size))
    share, apart = (1 + similarity) / similarity, (1 - similarity) / (1 + similarity)

    def lookups(batch: pa.RecordBatch) -> dict:
        out: dict = {c: [] for c in ("h0", "h1", "size", "fp", *_WORDS, "keys")}
        for t in texts(batch):
            h = shingle_set(t, size)
            n = len(h)
            most = np.floor((n - np.arange(n)) * share - n + 1e-6)  # the size of the largest partner
            keys = h[np.lexsort((h, counts.value[h % np.uint64(BUCKETS)]))[: np.count_nonzero(most >= math.ceil(similarity * n - 1e-6))]]
            name = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), "<i8")
            for c, x in zip(out, (name[0], name[1], n, simhash(h), *parities(h), keys.view(np.int64)), strict=True):
                out[c].append(x)
        return {"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), **out}

    schema = "doc_id long, text_hash long, h0 long, h1 long, size int, fp long, " + "".join(f"{p} long, " for p in _WORDS) + "keys array<long>"
    made = cut(map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text"), lookups, schema, 512), "lookups")
    facts = ["size", "fp", *_WORDS, "keys"]
    alike = made.groupBy("h0", "h1").agg(F.min("doc_id").alias("low"), F.min_by("text_hash", F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("text_hash"), F.first(F.struct(*facts)).alias("f"))
    # the number of a set, fixed by writing it
    distinct = cut(alike.select(F.monotonically_increasing_id().alias("node"), "h0", "h1", "low", "text_hash", "f.*"), "distinct")

    most = F.floor((F.col("size") - F.col("place")) * share - F.col("size") + 1e-6)
    keyed = distinct.select("node", "size", F.posexplode("keys").alias("place", "key")).withColumn("most", most.cast("int"))
    groups = keyed.groupBy("key").agg(F.count("*").alias("n"), F.max(F.col("most") - F.col("size")).alias("reach")).where("n > 1 and reach >= 0").select("key")
    shared = cut(keyed.join(cut(groups, "keys"), "key"), "shared")
    fit = (F.col("most_a") >= F.col("size_b")) & (F.col("most_b") >= F.col("size_a"))

    def pairs(a: Column, b: Column) -> list[Column]:
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    rough = distinct.select("node", "size", *_WORDS)

    def roughly(x: str, y: str) -> Column:
        """Whether the parities of two sides leave it open that they are at the similarity."""
        differ = sum((F.bit_count(F.col(f"{p}_{x}").bitwiseXOR(F.col(f"{p}_{y}"))) for p in _WORDS), F.lit(0))
        return differ <= (F.col(f"size_{x}") + F.col(f"size_{y}")) * apart + 1e-6

    def verified(candidates: DataFrame, by: str) -> DataFrame:
        """Those of the candidates (a, b), whose parities leave it open, that are at the similarity. Only sets that are asked for are made again from their texts."""
        near = cut(candidates.distinct(), f"{by}-pairs")
        asked = cut(near.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(distinct.select("node", "low", "text_hash"), "node"), f"{by}-asked")
        at = asked.select("node", F.col("low").alias("doc_id"), "text_hash")
        theirs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").alias("d").join(at.alias("q"), F.col("d.doc_id").eqNullSafe(F.col("q.doc_id")) & (F.col("d.text_hash") == F.col("q.text_hash")))

        def as_sets(batch: pa.RecordBatch) -> dict:
            return {"node": batch.column("node"), "set": pa.array([shingle_set(t, size).view(np.int64) for t in texts(batch)], pa.list_(pa.int64()))}

        sets = cut(map_arrow(theirs.select("q.node", "d.text"), as_sets, "node long, set array<long>", 256).dropDuplicates(["node"]), f"{by}-sets")
        held = near.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
        both = held.select("a", "b", F.size(F.array_intersect("x", "y")).alias("both"), (F.size("x") + F.size("y")).alias("sizes"))
        return cut(both.where(F.col("both") + 1e-9 >= similarity * (F.col("sizes") - F.col("both"))).select("a", "b"), f"{by}-edges")

    # sets of one fingerprint, and of fingerprints within a few bits, by one set each
    of_fp = cut(distinct.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")), "fingerprints")
    same = distinct.select("node", "fp").join(of_fp.where("n > 1"), "fp").where("node <> first").select(*pairs(F.col("node"), F.col("first")))
    by_bits = links(of_fp.select("fp"), bits).join(of_fp.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(of_fp.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b").select(*pairs(F.col("x"), F.col("y")))
    hub = shared.groupBy("key").agg(F.min_by(F.struct("node", "size", "most"), F.struct("place", F.xxhash64("node"))).alias("h")).select("key", *(F.col(f"h.{c}").alias(f"{c}_b") for c in ("node", "size", "most")))
    by_hub = _sides(shared.drop("place"), "a", "key").join(cut(hub, "hubs"), "key").where((F.col("node_a") != F.col("node_b")) & fit).select(*pairs(F.col("node_a"), F.col("node_b")))
    first = same.unionByName(by_bits).unionByName(by_hub).distinct()
    first = first.join(_sides(rough.withColumnRenamed("node", "a"), "x", "a"), "a").join(_sides(rough.withColumnRenamed("node", "b"), "y", "b"), "b").where(roughly("x", "y"))
    edges = verified(first.select("a", "b"), "hub")

    found = cut(components(edges), "found")
    rows = shared.join(found, "node", "left").withColumn("of", F.coalesce("component", "node")).drop("component")
    open_ = rows.groupBy("key").agg(F.min("of").alias("x"), F.max("of").alias("y")).where("x <> y").select("key")
    left = cut(rows.join(open_, "key"), "open")
    if not left.isEmpty():
        main = left.groupBy("key", "of").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("of", F.struct("n", "of")).alias("main"))
        # parities are part of the join's condition: a family of sets that aren't at the similarity is compared in place, and no pair of it is made
        marked = cut(left.join(main, "key").withColumn("out", F.col("of") != F.col("main")).drop("main", "place").join(rough.drop("size"), "node"), "marked")
        across = (F.col("of_a") != F.col("of_b")) & (~F.col("out_b") | (F.col("node_a") < F.col("node_b")))
        rest = _sides(marked.where("out"), "a", "key").join(_sides(marked, "b", "key"), "key").where(across & fit & roughly("a", "b"))
        edges = edges.unionByName(verified(rest.select(*pairs(F.col("node_a"), F.col("node_b"))), "rest"))
        found = cut(components(edges), "found")
    grouped = cut(distinct.select("node", "h0", "h1", "low").join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "grouped")
    least = grouped.groupBy("component").agg(F.min("low").alias("component_id"))
    return made.select("doc_id", "text_hash", "h0", "h1").join(grouped.join(least, "component").select("h0", "h1", "component_id", "component"), ["h0", "h1"]).select("doc_id", "text_hash", "component_id", "component")
