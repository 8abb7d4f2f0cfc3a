"""python -m quillspark.cli: run a registered query over a folder of tables, or take documents from texts to drafts, edits, rules and an evaluation.

Folders hold JSON lines as Spark writes them; a document is a text file, named by its id.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import observe
from .functions.rules import DOCUMENT_TYPES
from .functions.text import first_match
from .operators import chunk, draft, evaluate, extract, learn, retrieve
from .sources.tables import RuleStore, read_or_empty, write_json, written

EVENTS = "edit_id string, matter_id string, section string, field_path string, before string, after string, edit_type string, operator_note string, seq long"
SENTENCES = "matter_id string, section string, field string, ordinal int, text string"
GOLD = "key string, section string, text string, pages array<int>"
EVALUATION = "Summarize the vested owner, legal description, liens, requirements and exceptions"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the file's stem), doc_type, text of each text file."""
    files = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return files.select(stem.alias("doc_id"), first_match(F.concat_ws("\n", stem, F.substring("value", 1, 3000)), DOCUMENT_TYPES, "other").alias("doc_type"), F.col("value").alias("text"))


def _chunks(docs: DataFrame, documents: DataFrame) -> DataFrame:
    vesting = documents.select("doc_id", F.posexplode("vesting").alias("ordinal", "p")).select("doc_id", "ordinal", "p.name", "p.role")
    return chunk.contextual_chunks(docs, vesting)


def _drafted(spark: SparkSession, docs: DataFrame, events: str | None, rules: str | None) -> tuple[DataFrame, DataFrame]:
    """Sections of each document, and its chunks."""
    documents = extract.title_documents(docs)
    chunks = _chunks(docs, documents)
    log = read_or_empty(spark, events, spark.createDataFrame([], EVENTS).schema) if events else None
    found = None if log is None else draft.learnt(documents, log)
    return draft.sections(documents, draft.retrieved(chunks), found, RuleStore(spark, rules).load() if rules else None), chunks


def sentences(drafted: DataFrame) -> DataFrame:
    """Drafts as rows that can be edited and compared: summary, findings, gaps and flags by place."""
    lists = {"summary": F.array("text"), "bullet_findings": F.transform("findings", lambda f: f["text"]), "gaps": F.col("gaps"), "flags": F.array("flag")}
    item = lambda field: lambda t, i: F.struct(F.lit(field).alias("field"), i.alias("ordinal"), t.alias("text"))
    parts = F.flatten(F.array(*(F.transform(v, item(k)) for k, v in lists.items())))
    return drafted.select(F.col("doc_id").alias("matter_id"), "section", F.inline(parts))


def _ingest(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return extract.title_documents(read_texts(spark, a.path))


def _index_query(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    docs = read_texts(spark, a.path)
    chunks = _chunks(docs, extract.title_documents(docs)).select(F.lit(0).alias("corpus_key"), "chunk_id", F.col("contextual_text").alias("text"))
    query = spark.createDataFrame([(0, 0, a.query)], "corpus_key int, query_id int, text string")
    return retrieve.hybrid(chunks, query, k=a.top).join(chunks, ["corpus_key", "chunk_id"]).select("rank", "score", "chunk_id", "text").orderBy("rank")


def _draft(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    drafted, _ = _drafted(spark, read_texts(spark, a.path), a.events, a.rules)
    return sentences(drafted) if a.sentences else draft.summaries(drafted)


def _learn_capture(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    before, after = (spark.read.schema(SENTENCES).json(p) for p in (a.baseline, a.edited))
    first = spark.sparkContext.startTime
    return learn.diff(before, after).withColumn("operator_note", F.lit(a.note)).withColumn("seq", F.lit(first).cast("long")).select(*(n.split(" ")[0] for n in EVENTS.split(", ")))


def _learn_distill(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    store = RuleStore(spark, a.rules)
    log = spark.read.schema(EVENTS).json(a.events).where(F.lit(True) if a.section is None else F.col("section") == a.section)
    made = written(learn.distilled(log, store.load()), "distilled")
    store.save(made)
    return made


def _eval_run(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    docs = read_texts(spark, a.path)
    gold = spark.read.schema(GOLD).json(a.gold)
    cased = evaluate.cases(docs.select("doc_id"), gold.select(F.col("key").alias("doc_id")).distinct(), docs)
    pages = gold.select(F.col("key").alias("query_id"), F.explode_outer("pages").alias("page")).select("query_id", F.when(F.col("page").isNotNull(), F.col("query_id")).alias("doc_id"), "page")
    learnt = RuleStore(spark, a.rules).load().select(F.inline("rules")).select(F.col("id").alias("rule_id"), "text")
    out = None
    for name, events, rules in (("pre", None, None), ("post", a.events, a.rules)):
        drafted, chunks = (written(x, name) for x in _drafted(spark, cased, events, rules))
        corpus = chunks.select(F.col("doc_id").alias("corpus_key"), "chunk_id", F.col("contextual_text").alias("text"))
        asked = chunks.select(F.col("doc_id").alias("corpus_key")).distinct().select("corpus_key", F.lit(0).alias("query_id"), F.lit(EVALUATION).alias("text"))
        found = retrieve.hybrid(corpus, asked).select(F.col("corpus_key").alias("query_id"), "chunk_id", "rank").join(chunks.select(F.col("doc_id").alias("query_id"), "chunk_id", "page", F.col("contextual_text").alias("text")), ["query_id", "chunk_id"])
        hits = found.select("query_id", "rank", F.col("query_id").alias("doc_id"), "page", "text")
        one = evaluate.measured(drafted, draft.summaries(drafted), gold.select("key", "section", "text"), pages, hits, learnt if rules else None).withColumn("condition", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return evaluate.paired(evaluate.aggregated(out))


_VERBS = {
    "ingest": (_ingest, ["path"], {}),
    "index-query": (_index_query, ["path"], {"--query": "Who is the vested owner?", "--top": 5}),
    "draft": (_draft, ["path"], {"--events": None, "--rules": None}),
    "learn-capture": (_learn_capture, ["baseline", "edited"], {"--note": None}),
    "learn-distill": (_learn_distill, ["events", "rules"], {"--section": None}),
    "eval-run": (_eval_run, ["path", "gold", "events", "rules"], {}),
}


def main(args: list[str] | None = None) -> int:
    from .plans import registry

    parser = argparse.ArgumentParser(prog="quillspark")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("query", choices=sorted(registry.QUERIES))
    run.add_argument("tables")
    run.add_argument("--out", help="write JSON there; else show the first rows")
    for name, (_, needed, given) in _VERBS.items():
        verb = sub.add_parser(name)
        for n in needed:
            verb.add_argument(n)
        for n, default in given.items():
            verb.add_argument(n, default=default, type=type(default) if default is not None else str)
        if name == "draft":
            verb.add_argument("--sentences", action="store_true", help="rows that can be edited instead of nested summaries")
        verb.add_argument("--out")
    found = parser.parse_args(args)
    if found.command == "list":
        print("\n".join(sorted(registry.QUERIES)))
        return 0
    spark = SparkSession.builder.getOrCreate()
    observe.bind()
    with observe.step(found.command, observe.logger("quillspark")):
        df = registry.QUERIES[found.query](spark, found.tables) if found.command == "run" else _VERBS[found.command][0](spark, found)
        if found.out:
            write_json(df, found.out)
        else:
            df.show(20, truncate=80)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
