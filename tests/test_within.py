"""Search within small corpora against the search over shuffled rows."""

import random
import time

from pyspark.sql import functions as F

from conftest import TINY
from quillspark.operators import chunk, draft, evaluate, index, retrieve, within
from quillspark.plans import sections


def _exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_within_is_hybrid(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(25)] + ["deed", "vested", "Vested", "Schedule", "été", "a-b"]
    texts = [(k, f"{k}:{i:04}", " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 8, 40])))) for k in range(12) for i in range(rng.choice([1, 2, 7, 45]))]
    texts += [(99, "99:0000", "")]
    queries = ["w1 w2 deed Schedule", "vested w3, w3", "unheard of"]
    rows = spark.createDataFrame(texts, "corpus_key int, chunk_id string, text string")
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id int, text string")
    theirs = sorted((r["corpus_key"], r["query_id"], r["rank"], r["chunk_id"]) for r in retrieve.hybrid(rows, asked).collect())
    listed = rows.groupBy("corpus_key").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "text"))).alias("chunks"))
    found = within.search(listed, queries, lambda c: c["text"]).collect()
    ours = sorted((r["corpus_key"], q, n + 1, r["chunks"][p]["chunk_id"]) for r in found for q, places in enumerate(r["places"]) for n, p in enumerate(places))
    assert ours == theirs
    assert len(found) == 13 and any(len(p) == 5 for r in found for p in r["places"])


def test_corpora_are_scored_in_parts(spark, monkeypatch):
    listed = spark.createDataFrame([(k, [{"text": f"deed {k} w{i}"} for i in range(k)]) for k in range(9)], "k int, chunks array<struct<text:string>>").coalesce(1)
    whole = [r["places"] for r in within.search(listed, ["deed w3"], lambda c: c["text"]).orderBy("k").collect()]
    monkeypatch.setattr(within, "AT_ONCE", 1)
    assert [r["places"] for r in within.search(listed, ["deed w3"], lambda c: c["text"]).orderBy("k").collect()] == whole
    assert whole[0] == [[]] and whole[5][0][0] == 3


def test_sections_search_shuffles_nothing(spark):
    """Only the orders are dealt out."""
    assert _exchanges(sections.section_retrieval(spark, TINY)) <= 1


def test_rows_and_lists_are_found_alike(spark):
    docs = spark.createDataFrame([(1, "survey", " ".join(f"deed{i % 7} book {i} vested" for i in range(90))), (2, "survey", ""), (3, "deed", "taxes " * 200)], "doc_id long, doc_type string, text string")
    rows = chunk.contextual_chunks(docs, spark.createDataFrame([], "doc_id long, ordinal int, name string, role string"), 80, 20)
    shown = lambda df: {r["doc_id"]: [[(r["hits"][p]["start"], r["hits"][p]["text"]) for p in ps] for ps in r["places"]] for r in df.collect() if r["hits"]}
    ours = shown(draft.retrieved_of(chunk.listed_chunks(docs, 80, 20)))
    assert ours == shown(draft.retrieved(rows)) and set(ours) == {1, 3}


def test_supported_is_faithfulness(spark):
    hits = [["alpha beta gamma"], ["one word here"], []]
    claims = ["alpha beta delta", "alpha nowhere other things besides more", "the of", None]
    rows = [(f"{i}/{j}", c, h) for i, h in enumerate(hits) for j, c in enumerate(claims)]
    df = spark.createDataFrame(rows, "key string, text string, hits array<string>")
    listed = df.select("key", F.posexplode("hits").alias("hit_id", "text"))
    theirs = {r["key"]: r["faithfulness"] for r in evaluate.faithfulness(df.select("key", F.lit(0).alias("claim_id"), "text"), listed).collect()}
    mine = df.select("key", evaluate.supported(F.col("text"), F.transform("hits", lambda h: evaluate.content_tokens(h))).cast("double").alias("x"))
    assert {r["key"]: r["x"] for r in mine.collect()} == theirs


def test_windows_count_tokens_once(spark):
    """Texts of 20,000 words, 1,333 windows each: their tokens were counted for each window."""
    long = spark.range(4).select(F.col("id").alias("doc_id"), F.expr("repeat('word ', 20000)").alias("text"))
    begun = time.monotonic()
    rows = chunk.token_windows(long, 20, 5, None).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("end").alias("end")).collect()
    assert {(r["n"], r["end"]) for r in rows} == {(1333, 20000)}
    assert time.monotonic() - begun < 15


def test_blocks_of_vectors_are_pairs(spark, monkeypatch):
    """Copies, ties, and vectors that are null, short, or not finite: the same rows as pair by pair."""
    rng = random.Random(2)
    rows = [(i, [rng.choice([0.0, 0.25, -1.0, 0.1234565]) for _ in range(6)]) for i in range(300)] + [(400, None), (401, [1.0]), (402, [None] * 6), (403, [float("inf")] * 6), (404, [float("nan")] * 6), (405, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, v array<double>")
    asked = vectors.where("vec_id % 50 = 0 or vec_id in (402, 403)")
    pairs = vectors.join(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), F.col("vec_id") != F.col("query_id"))
    product = F.aggregate(F.zip_with("v", "q", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    shown = lambda df: sorted((str(tuple(r)) for r in df.select("query_id", "vec_id", "score", "rank").collect()))
    theirs = shown(retrieve.top(pairs.select("query_id", "vec_id", product.alias("score")), 30, 6, ("query_id",), "vec_id"))
    monkeypatch.setattr(retrieve, "VECTORS", 64)
    monkeypatch.setattr(retrieve, "QUERIES", 4)
    found = retrieve.cosine_top(vectors, asked)
    assert shown(found) == theirs
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString()


def test_vectors_deal_texts_out_once(spark):
    """Postings aren't shuffled for dense vectors, once by token and once by chunk for weighted ones; copies of a chunk's id count as one chunk."""
    chunks = spark.createDataFrame([(0, i % 40, f"deed w{i % 7} w{i % 11} deed") for i in range(90)], "corpus_key int, chunk_id long, text string")
    dense = index.dense_vectors(chunks)
    assert _exchanges(dense) == 1
    norms = dense.groupBy("chunk_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("n")).collect()
    assert len(norms) == 40 and all(abs(r["n"] - 1) < 1e-9 for r in norms)
    assert {r["tf"] for r in index.postings(chunks).where("chunk_id = 3 and token = 'deed'").collect()} == {6}
