"""A training corpus from raw documents: five stages, each an operator of quillspark.llm applied to what the stage before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import mixing, packing, secrets, simhash, toxicity
from quillspark.llm.common import cut, free, table


def _own(docs: DataFrame) -> list[Column]:
    """The columns of documents, whatever their names."""
    return [F.col(f"`{c}`") for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5 as `labels.toxic` marks toxicity; one at just 0.5 goes. Null and empty texts score as texts without evidence; repeated rows
    fare alike. Without labels all stay. Empty table: no rows."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = free(docs.columns, "toxicity")
    return toxicity.score(docs, model, score, free(docs.columns, "passages")).where(F.col(score) < 0.5).select(*_own(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are similar by 0.8 or more: that of the smallest doc_id. Null, empty and blank texts are a group.
    Repeated rows stay once; of rows that share a doc_id and a group, the one whose text has the smallest hash stays; rows without doc_id all stay. Empty table: no rows."""
    groups = cut(simhash.near_duplicates(docs, 5, similarity=0.8).where("doc_id is not null"), "groups")
    again = cut(groups.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated-ids")
    away = cut(groups.where("doc_id <> component_id").select("doc_id").unionByName(again).distinct(), "away")
    chosen = free(docs.columns, "text_hash")
    one = groups.join(again, "doc_id", "left_semi").where("doc_id = component_id").groupBy("doc_id", "component").agg(F.min("text_hash").alias(chosen)).select("doc_id", chosen)
    theirs = docs.join(one, "doc_id").where(F.xxhash64("text") == F.col(chosen)).dropDuplicates(["doc_id", "text"])
    return docs.join(away, "doc_id", "left_anti").select(*_own(docs)).unionByName(theirs.select(*_own(docs)))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark; n_chars follows, where a document has it. Null texts stay null; repeated rows come out alike. Empty table: no rows."""
    out = secrets.redact(docs, secrets.fit(secrets.samples(docs)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*_own(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, at most three times; rows that repeat a document as often each. Null and empty texts have no words, and aren't taken.
    Empty table: no rows."""
    names = []
    for n in ("id", "of", "words", "copies", "size", "copy"):
        names.append(free([*docs.columns, *names], n))
    id_, of, words, copies, size, copy = names
    taken = mixing.mix(docs).where("copies > 0").select(F.col("doc_id").alias(id_), F.col("source").alias(of), F.col("size").alias(words), F.col("copies").alias(copies)).distinct()
    sized = docs.withColumn(size, F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0)).cast("long"))
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & F.col("source").eqNullSafe(F.col(of)) & (F.col(size) == F.col(words))
    return sized.join(taken, same).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*_own(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens. A null text is packed as an empty one; copies each by themselves. Empty table: no rows."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]
#: Learned scores, fingerprints and tokens aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
