"""Packing of tokenised documents into fixed sequences by first-fit decreasing over a tournament tree.

Documents are cut at multiples of the sequence length; the full pieces fill sequences of their own, and the rests are
packed in randomised groups, independent of one another, so that a task holds one group at a time. Texts are
tokenised once and never shuffled: what travels is a short row for each piece.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import cut, map_arrow, ship, table

#: The pre-tokenizer's pattern of byte-level BPE vocabularies of this family. Fixed values, public.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: tiktoken's matcher gives up on runs of white space of somewhere under a million characters.
LONG_RUN = 1 << 16
_LONG = re.compile(rf"\s{{{LONG_RUN}}}")
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes, those that the tokenizers library gives.

    Reads a byte-level BPE vocabulary in which ids follow the order of merges; the merging itself is done by the faster of the
    installed libraries. Texts that hold an added token's string, or a run of white space too long for the other's pattern, are left to
    tokenizers itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        names = _byte_names()
        self._library = Tokenizer.from_file(path)
        special = {t.content for t in self._library.get_added_tokens_decoder().values()}
        ranks = {bytes(map(names.__getitem__, t)): i for t, i in self._library.get_vocab(with_added_tokens=False).items() if t not in special}
        self._encode = tiktoken.Encoding("byte-level", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_to_tiktoken_buffer
        self._special = re.compile("|".join(map(re.escape, sorted(special))) or r"(?!)")

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self._by_library(t) if self._special.search(t) or len(t) >= LONG_RUN and _LONG.search(t) else bytes(self._encode(t, set())) for t in texts]

    def _by_library(self, text: str) -> bytes:
        return np.array(self._library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def pieces(docs: DataFrame, length: int = 1024, path: str | None = None) -> DataFrame:
    """Each document's ids, with id 0 after them, cut at multiples of `length`: a row for each piece, and the group key of its row."""
    path, made = path or vocabulary(), {}

    def run(batch: pa.RecordBatch) -> dict:
        if "encoder" not in made:
            made["encoder"] = Encoder(path)
        out: dict = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "row")}
        docs_, parts, rows = (batch.column(c).to_pylist() for c in ("doc_id", "part", "row"))
        encoded = made["encoder"].encode([t or "" for t in batch.column("text").to_pylist()])
        for doc_id, part, row, ids in zip(docs_, parts, rows, encoded, strict=True):
            ids += b"\0\0\0\0"
            n = len(ids) // 4
            for a in range(0, n, length):
                piece = ids[4 * a : 4 * (a + length)]
                for k, v in zip(out, (doc_id, a, len(piece) // 4, zlib.crc32(piece), n, part, row), strict=True):
                    out[k].append(v)
        return out

    numbered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"))
    return map_arrow(numbered, run, f"{PIECES}, part int, row long", 256)


class Tournament:
    """A complete binary tree over bins, each node with the largest capacity below it."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(0, bins - 1).bit_length()
        self.tree = [capacity] * (2 * self.size)

    def first_fit(self, need: int) -> int:
        """Takes `need` from the first bin that has it."""
        tree, i = self.tree, 1
        while i < self.size:
            i *= 2
            if tree[i] < need:
                i += 1
        tree[i] -= need
        found = i - self.size
        while i > 1:
            i //= 2
            a, b = tree[2 * i], tree[2 * i + 1]
            top = a if a >= b else b
            if tree[i] == top:
                break
            tree[i] = top
        return found


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and offset of each item. Items of equal length keep their order."""
    bins, offsets, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), {}
    tree = Tournament(max(1, len(lengths)), capacity)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        bins[i] = b = tree.first_fit(n)
        offsets[i] = used.get(b, 0)
        used[b] = used.get(b, 0) + n
    return bins, offsets


def pack(docs: DataFrame, length: int = 1024, group_rows: int = 8192, path: str | None = None) -> DataFrame:
    """PIECES, sequence_id, offset: where each piece of each document lies.

    docs needs doc_id and text. A null or empty text is the one id 0. Repeated rows are packed each by itself; a
    null doc_id stays null; other columns aren't read. Pieces of equal length go in the order of the input. Groups are drawn by a hash of the row's place in the input, not of doc_id, so no key can fill one; each
    has about `group_rows` pieces. Empty table: no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    cut_up = cut(pieces(docs, length, path), "pieces")
    n = cut_up.count()
    groups = max(1, -(-n // group_rows))
    keyed = cut_up.withColumn("bucket", F.pmod(F.xxhash64("part", "row", "start"), F.lit(groups)))
    schema = StructType.fromDDL(f"{PIECES}, sequence_id long, offset long")

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("part", "ascending"), ("row", "ascending"), ("start", "ascending")])
        bins, offsets = first_fit_decreasing(rows.column("length").to_numpy(), length)
        base = key[0].as_py() << 32
        return rows.select([f.name for f in schema][:5]).append_column("sequence_id", pa.array(bins + base)).append_column("offset", pa.array(offsets))

    return keyed.groupBy("bucket").applyInArrow(run, schema)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack of all documents into sequences of 1024."""
    return pack(table(spark, sf_dir, "documents"))
