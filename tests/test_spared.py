"""Searches that are spared, and rows that aren't shuffled: the results are those of the longer way."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from conftest import TINY
from quillspark.functions import nested, rules, text
from quillspark.functions.spans import first_span, numbered
from quillspark.operators import chunk, draft, evaluate, extract, index, learn
from quillspark.plans import review
from quillspark.plans.extraction import _DOCUMENTS, _LIENS, _TYPES, _texts
from quillspark.sources import tables


def test_composable_is_title_documents_in_short(spark):
    for body in (_DOCUMENTS, _LIENS):
        docs = _texts(spark, TINY, body, doc_type=_TYPES)
        whole = extract.title_documents(docs).select(
            "doc_id", F.col("effective_date.value").cast("string").alias("effective_date"), F.col("proposed_insured.value").alias("proposed_insured"), F.col("policy_amount.value").cast("double").alias("policy_amount"),
            F.transform("chain_of_title", lambda x: x["instrument"]).alias("instruments"), F.transform("easements", lambda x: x["type"]).alias("easements"),
        )
        short = extract.composable(docs)
        assert sorted(map(str, short.collect())) == sorted(map(str, whole.collect()))


def test_dates_are_tried_by_formats_that_may_fit(spark):
    texts = ["1/5/1996", "13/45/1999", "1-5-1996", "01-05-1996", "001-05-1996", "1996-01-05", "1996-1-5", "January 5, 1996", "Jan 5, 1996", "May 5, 1996", "may  5, 1996", "MARCH 5, 1996", "Sept 5, 1996", "5 May 1996", "", "x", "1/5-1996", "+1-5-1996", "May 5 1996"]
    rows = spark.createDataFrame([(x,) for x in texts], "t string")
    every = F.coalesce(*(F.try_to_timestamp(F.regexp_replace("t", r"\s+", " "), F.lit(f)).cast("date") for f in rules.DATE_FORMATS))
    for r in rows.select("t", text.parsed_date(F.col("t")).alias("a"), every.alias("b")).collect():
        assert r["a"] == r["b"], r


def test_starts_of_first_matches(spark):
    texts = ["é Effective Date: 1/5/1996", "Effective Dates; effective  date 1/5/1996, Effective Date: 2/5/1996", "$ 3 and $3", "an xinsured: Named Insured: Ann Lee", "fee simple estates. Fee Simple estate", None, ""]
    rows = spark.createDataFrame([(x,) for x in texts], "t string")
    for p in (*rules.EFFECTIVE_DATE, *rules.INSURED, *rules.ESTATE, rules.AMOUNT, rules.POLICY_AMOUNT):
        for r in rows.select("t", first_span(F.col("t"), extract._any_case(p)).alias("m")).collect():
            m = re.search("(?i)" + p, r["t"] or "", re.A)
            assert (r["m"] and tuple(r["m"])) == (m and (m.start(), m.end(), m[0])), (p, r)


def test_white_space_squeezed(spark):
    r = spark.createDataFrame([(" a  b\tc\n d \r\n e ",)], "t string").select(extract.squeezed(F.col("t"))).first()
    assert r[0] == "a b c d e"


def test_values_of_json_alone(spark):
    rows = spark.createDataFrame([('{"a": 1, "b": ["x", 7]}',), ('{"a": "no"}',), ("no",), (None,)], "t string")
    kind = "a int, b array<string>"
    assert [r[0] for r in rows.select(nested.value_of(F.col("t"), kind)).collect()] == [r[0] for r in rows.select(nested.parsed(F.col("t"), kind)["value"]).collect()]


def test_claims_meet_hits_in_parts(spark, monkeypatch):
    """Brute force over keys of many and of few texts, with parts and blocks far smaller than the texts, odd keys and texts among them."""
    rng = random.Random(5)
    say = lambda n: " ".join(f"word{rng.choice('abcdefghijklmnopqrstuvwxyz')}{rng.randrange(60)}" for _ in range(n))
    claims = [(k, f"{k}:{i}", say(rng.randrange(45))) for k, m in ((1, 300), (2, 5), (3, 1), (4, 2)) for i in range(m)] + [(1, "none", None), (1, "empty", ""), (1, "stop", "the of and"), (None, "no key", "worda1")]
    hits = [(k, i, say(rng.choice([0, 3, 30, 200]))) for k, m in ((1, 40), (2, 3), (3, 1), (9, 2)) for i in range(m)] + [(1, None, None), (None, 7, "worda1"), (4, 1, None)]
    tokens = lambda t: {w for w in (t or "").lower().split() if len(w) >= 4}
    want = {}
    for k, _, t in claims:
        mine = tokens(t)
        want.setdefault(k, []).append(bool(mine) and any(k is not None and h == k and len(mine & tokens(x)) / len(mine) >= evaluate.SUPPORTED for h, _, x in hits))
    for part, at_once in ((400, 3), (16_000_000, 512)):
        monkeypatch.setattr(evaluate, "PART", part)
        monkeypatch.setattr(evaluate, "AT_ONCE", at_once)
        found = evaluate.faithfulness(spark.createDataFrame(claims, "key long, claim_id string, text string"), spark.createDataFrame(hits, "key long, hit_id long, text string"))
        assert {r["key"]: (r["n_claims"], r["faithfulness"]) for r in found.collect()} == {k: (len(v), round(sum(v) / len(v), 6)) for k, v in want.items()}
        assert len(set(want[1])) == 2
    assert "token" not in found._jdf.queryExecution().optimizedPlan().toString().lower().replace("tokens", "")  # no row is a token


def test_tokens_that_a_claim_needs():
    for n in range(1, 400):
        assert evaluate._needed(np.array([n]))[0] == min(i for i in range(n + 1) if i / n >= evaluate.SUPPORTED)


def test_vectors_on_their_rows(spark):
    """Vectors of rows are those of the shuffled index."""
    texts = ["Lien deed lien, tax", "", None, "é x y", "deed", "a a a b " * 50]
    rows = spark.createDataFrame([(1, f"c{i}", t) for i, t in enumerate(texts)], "corpus_key int, chunk_id string, text string")
    want = {}
    for r in index.dense_vectors(rows).collect():
        want.setdefault(r["chunk_id"], {})[r["bucket"]] = round(r["weight"], 9)
    found = index.with_dense_vectors(rows, F.col("text"))
    assert found.columns == [*rows.columns, "vector"]
    assert {r["chunk_id"]: {x["bucket"]: round(x["weight"], 9) for x in r["vector"]} for r in found.collect() if r["vector"]} == want
    assert "Exchange" not in index.with_dense_vectors(spark.range(3), F.lit("a b"))._jdf.queryExecution().executedPlan().toString()


def test_starts_of_windows_alone(spark):
    """Windows without their texts begin where those with texts do, and pages are the same with a look before the marks."""
    docs = spark.createDataFrame([(1, " é a  bb\n\tccc Page 3 d e\n## Page 4 f xPage 5 PAGE 6 g " * 9), (2, ""), (3, None), (4, "one")], "doc_id int, text string")
    for size, overlap in ((4, 1), (60, 10), (3, 0)):
        whole = docs.select("doc_id", F.transform(chunk.window_spans(F.col("text"), size, overlap, None), lambda w: F.struct(w["idx"].alias("idx"), w["start"].alias("start"))).alias("w"), chunk.window_starts(F.col("text"), size, overlap, None).alias("s")).collect()
        assert all(r["w"] == r["s"] for r in whole) and any(r["w"] for r in whole)
    for marks in (chunk.PAGE_MARKS, chunk.HEADINGS):
        assert chunk._LOOK[marks] != marks
        assert all(r[0] == r[1] for r in docs.select(numbered(F.col("text"), marks), numbered(F.col("text"), chunk._LOOK[marks])).collect())


def test_drafts_are_made_once_for_their_claims(spark):
    """Sections, findings and the overall sentence each made all drafts anew."""
    claims, whole = review.draft_claims(spark, TINY), review.draft_summaries(spark, TINY)
    generated = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Generate inline")
    assert generated(claims) == generated(whole) + 1


def test_claims_of_summaries(spark):
    drafted = tables.written(draft.sections(*review._short_documents(spark, TINY, review._MIXED)), "drafted")
    whole = tables.written(draft.summaries(drafted), "summaries")
    shown = lambda df: sorted(map(str, df.select("doc_id", "claim_id", "text", "snippet").collect()))
    assert shown(evaluate.spoken_in(whole)) == shown(evaluate.spoken(drafted, whole))


def test_queries_of_edits_apart(spark):
    """The same edits are found, without a shuffle of the queries' tokens: their vectors were sums over rows of tokens."""
    events = spark.createDataFrame([("e1", "s1", "wording", "the deed of Ann", "the new deed"), ("e2", "s1", "wording", "a lien in book 7", "none"), ("e3", "s2", "addition", "", "taxes are due")], "edit_id string, section string, edit_type string, before string, after string")
    texts = ["deed of Ann, book 7, deed", "taxes due", "", None, "nothing alike zzz"]
    queries = spark.createDataFrame([(f"{i}/{s}", s, t) for i, t in enumerate(texts) for s in ("s1", "s2", "s3")], "query_id string, section string, text string")
    shown = lambda df: sorted(map(str, df.collect()))
    assert shown(learn.search(events, queries, 2, apart=True)) == shown(learn.search(events, queries, 2))
    tokens = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Generate explode")
    assert tokens(learn.search(events, queries, 2, apart=True)) < tokens(learn.search(events, queries, 2))


def test_sections_of_schedules_are_searched_by_their_headings(spark):
    """A text that names a schedule was searched for its sections; what has any of their headings still is."""
    items = "\na. Pay the full premium amount to the title agent.\nb. Provide a survey of the land, and more of it.\n"
    heads = [("I. Requirements", "II. Exceptions"), ("i.  requirement", "ii.\nexception"), ("SCHEDULE B - Section I of it", "schedule  B – SECTION II of it"), ("Requirements to issue policy", "EXCEPTIONS FROM COVERAGE")]
    rows = spark.createDataFrame([(a + items, b + items) for a, b in heads] + [("Schedule B next" + items, "Schedule B next" + items)], "a string, b string")
    found = rows.select(F.size(extract.requirements(F.col("a"))), F.size(extract.exceptions(F.col("b")))).collect()
    assert [tuple(r) for r in found] == [(2, 2)] * 4 + [(0, 0)]
    for f in (extract.requirements, extract.exceptions):
        plan = rows.select(f(F.col("a")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert ", section)" in plan and ", schedule)" not in plan
