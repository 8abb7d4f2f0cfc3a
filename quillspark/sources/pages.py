"""Documents to pages: injected parsers over binary files, and the ordered fallback from cache to synthesized text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import content_length

PAGE = "doc_id string, page int, text string, parser string, warnings array<string>"
#: A text with less content than this goes on to the next reader.
LEAST_CONTENT = 200


def binary_files(spark: SparkSession, glob: str) -> DataFrame:
    """doc_id (the file's stem), content."""
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return spark.read.format("binaryFile").load(glob).select(stem.alias("doc_id"), "content")


def parse(files: DataFrame, make: Callable[[], Callable[[bytes], list[str]]], name: str, asked: DataFrame | None = None) -> DataFrame:
    """PAGE rows of each file by a parser that is built once a partition; a file it fails on is one row without text, with a warning. Blank pages are warned about.

    asked: doc_id, wanted: only these files are read, and of their pages those whose numbers are wanted; null: all.
    """
    files = files.select("doc_id", "content", F.lit(None).cast("array<int>").alias("wanted")) if asked is None else files.select("doc_id", "content").join(asked.select("doc_id", F.col("wanted").cast("array<int>").alias("wanted")), "doc_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = make()
        for frame in frames:
            rows = []
            for doc_id, content, wanted in zip(frame["doc_id"], frame["content"], frame["wanted"], strict=True):
                try:
                    pages = parser(content)
                except Exception as e:  # a parser's failure is a fact about the file, not about the job
                    rows.append((doc_id, 0, None, name, [f"{name} failed: {type(e).__name__}"]))
                    continue
                only = None if wanted is None else set(wanted)
                rows += [(doc_id, i, t, name, [] if t.strip() else ["empty page"]) for i, t in enumerate(pages, 1) if only is None or i in only]
            yield pd.DataFrame(rows, columns=["doc_id", "page", "text", "parser", "warnings"])

    return files.mapInPandas(run, PAGE)


def fallback(keys: DataFrame, *readers: DataFrame, least: int = LEAST_CONTENT) -> DataFrame:
    """doc_id, text, reader: of ordered tables (doc_id, text) the first whose text has enough content, else the last that has any."""
    joined = keys.select("doc_id")
    for i, r in enumerate(readers):
        joined = joined.join(r.select("doc_id", F.col("text").alias(f"_{i}")), "doc_id", "left")
    full = [F.when(content_length(F.coalesce(f"_{i}", F.lit(""))) >= least, F.struct(F.col(f"_{i}").alias("text"), F.lit(i).alias("reader"))) for i in range(len(readers))]
    some = [F.when(F.col(f"_{i}").isNotNull(), F.struct(F.col(f"_{i}").alias("text"), F.lit(i).alias("reader"))) for i in reversed(range(len(readers)))]
    return joined.select("doc_id", F.coalesce(*full, *some).alias("c")).select("doc_id", "c.text", "c.reader")


def synthesized(doc_id: Column, doc_type: Column, owners: Column, legal: Column, amount: Column) -> Column:
    """A short text out of structured fields, for documents that nothing else reads."""
    return F.concat_ws("\n", F.concat(F.lit("# "), doc_id), F.concat(F.lit("Document type: "), doc_type), F.concat(F.lit("Vesting: "), F.array_join(owners, ", ")), F.concat(F.lit("Legal description: "), F.coalesce(legal, F.lit(""))), F.concat(F.lit("Policy amount: "), F.coalesce(amount.cast("string"), F.lit(""))))


def write_vectors(vectors: DataFrame, make: Callable[[], Callable[[list[dict]], None]], batch: int = 100) -> None:
    """Sends rows to a vector store in batches; the client is built once a partition. Sends must be idempotent by id, as a lost task sends again."""

    def send(rows: Iterator) -> None:
        client, held = make(), []
        for r in rows:
            held.append(r.asDict(recursive=True))
            if len(held) == batch:
                client(held)
                held = []
        if held:
            client(held)

    vectors.foreachPartition(send)


def read_vectors(queries: DataFrame, make: Callable[[], Callable[[list[float], int], list[tuple[str, float]]]], k: int = 30) -> DataFrame:
    """query_id, chunk_id, score, rank: what a vector store finds for queries (query_id, v). The client is built once a partition."""

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for frame in frames:
            rows = [(q, c, float(s), i) for q, v in zip(frame["query_id"], frame["v"], strict=True) for i, (c, s) in enumerate(client(list(v), k), 1)]
            yield pd.DataFrame(rows, columns=["query_id", "chunk_id", "score", "rank"])

    return queries.select(F.col("query_id").cast("long").alias("query_id"), "v").mapInPandas(ask, "query_id long, chunk_id string, score double, rank int")


def simulated_edits(sentences: DataFrame) -> DataFrame:
    """Edits made by rule out of sentences (matter_id, section, ordinal, text): a citation added, a word changed, or the sentence dropped, by the ordinal; made: which of these, as a class of edits.

    A citation added to a text that tells of a book and a page already is a change of wording.
    """
    kind = F.col("ordinal") % 3
    cites = F.contains(F.lower("text"), F.lit("book")) & F.contains(F.lower("text"), F.lit("page"))
    made = F.when((kind == 0) & ~cites, "citation_fix").when(kind == 2, "deletion").otherwise("wording")
    after = F.when(kind == 0, F.concat("text", F.lit(" See Book 1, Page "), F.col("ordinal").cast("string"), F.lit("."))).when(kind == 1, F.regexp_replace("text", r"^\S+", "Revised")).otherwise("")
    return sentences.select("matter_id", "section", F.lit("summary").alias("field"), "ordinal", F.col("text").alias("before"), after.alias("after"), made.alias("made"))
