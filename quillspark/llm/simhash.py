"""SimHash near-duplicates by pigeonhole blocks, without ever pairing up a large group.

Fingerprints are compared once each, however many documents carry them. A fingerprint is cut into blocks; two that
differ in at most `bits` bits agree in all but `bits` blocks, so they meet under one combination of the others, where
their distance is verified. Combinations that many fingerprints share aren't paired: their members are linked
through the keys with up to one bit flipped: two fingerprints have such a key in common just if they differ in at most
two bits. Components follow by alternating large and small stars.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_arrow, table, texts

SEED = 42
BITS = 64


def shingles(text: bytes | None, size: int) -> list[bytes]:
    """Lower-cased (A-Z only) words, joined by a space in runs of `size`; a shorter sequence is one shingle."""
    words = (text or b"").lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))


def fingerprint(text: bytes | None, size: int = 3) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes, repeats included; no words: 0."""
    found = shingles(text, size)
    if not found:
        return 0
    total = np.zeros(BITS, np.int64)
    for i in range(0, len(found), 1 << 16):
        part = found[i : i + (1 << 16)]
        h = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in part), "<u8", len(part))
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(found), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fp: signed 64-bit SimHash of each text. Null and empty texts have fingerprint 0."""

    def run(batch: pa.RecordBatch) -> dict:
        fp = np.array([fingerprint(t, size) for t in texts(batch)], np.uint64)
        return {"doc_id": batch.column("doc_id").cast(pa.int64()), "fp": pa.array(fp.view(np.int64))}

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, fp long")


def _block_keys(bits: int) -> list[tuple[int, int]]:
    """(number, mask) of each combination of blocks on which a pair within `bits` bits must agree once."""
    blocks = bits + 2
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(edges)]
    return [(i, sum(masks[j] for j in kept)) for i, kept in enumerate(itertools.combinations(range(blocks), blocks - bits))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, bits: int = 2, largest: int = 64) -> DataFrame:
    """Edges (a, b) between fingerprints, whose components are those of all pairs within `bits` bits (1 or 2).

    distinct: one row per fp. Block keys with up to `largest` members are paired and verified; the members of others are
    linked through flipped keys, linear in their number.
    """
    if bits not in (1, 2):
        raise ValueError("bits: 1 or 2")
    keyed = distinct.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("block"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in _block_keys(bits)))).alias("k")).select("fp", "k.block", "k.key")
    sizes = keyed.groupBy("block", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(keyed.join(sizes, ["block", "key"]), "blocks")
    few = shared.where(F.col("n") <= largest)
    near = (
        few.select("block", "key", F.col("fp").alias("a"))
        .join(few.select("block", "key", F.col("fp").alias("b")), ["block", "key"])
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits))
        .select("a", "b")
    )
    crowded = shared.where(F.col("n") > largest).select("fp").distinct()
    flips = [F.lit(x).cast("long") for x in (0, *(_signed(1 << i) for i in range(BITS)))]
    around = crowded.select("fp", F.explode(F.array(*(F.col("fp").bitwiseXOR(x) for x in flips))).alias("key"))
    hub = around.groupBy("key").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("key", "b")
    starred = around.join(hub, "key").where("fp <> b").select(F.col("fp").alias("a"), "b")
    if bits == 1:  # a common neighbour alone would allow a distance of 2
        starred = around.join(crowded.select(F.col("fp").alias("key")), "key").where("fp <> key").select(F.col("fp").alias("a"), F.col("key").alias("b"))
    return near.unionByName(starred).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for each node with an edge; alternating large and small stars.

    Each round regroups edges around smaller neighbours; rounds grow with the logarithm of the longest path.
    """
    both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now = cut(both, "edges")
    before = None
    while True:
        two_way = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = two_way.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = two_way.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select("v", "m").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        now = cut(small, "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state


def near_duplicates(docs: DataFrame, size: int = 3, bits: int = 2, largest: int = 64, similarity: float | None = None) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable over links of at most `bits` differing bits, itself included).

    docs needs doc_id and text, other columns aren't read. Rows with a null doc_id keep their fingerprint; their component_id is the smallest
    doc_id of their component, or null if it has none. Repeated rows are all returned. Very long texts count whole. Empty table: no rows.
    With a similarity, links are those between texts whose sets of different shingles are similar, whatever their fingerprints: blocks find the closest, and an exact join the rest
    (see similar.near_duplicates, whose columns are then returned).
    """
    if similarity is not None:
        from . import similar

        return similar.near_duplicates(docs, size, similarity, bits)
    fps = cut(fingerprints(docs, size), "fingerprints")
    low = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    found = components(links(low.select("fp"), bits, largest))
    grouped = low.join(found, low.fp == found.node, "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    least = grouped.groupBy("component").agg(F.min("low").alias("component_id"))
    of_fp = grouped.join(least, "component").select("fp", "component_id")
    return fps.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each row of documents the fingerprint over three words, and the component at 2 bits."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
