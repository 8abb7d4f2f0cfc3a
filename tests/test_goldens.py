"""Results worked out by hand, and what holds for any input."""

import math
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import TINY
from quillspark import models
from quillspark.functions import text
from quillspark.functions.spans import match_spans
from quillspark.operators import chunk, draft, evaluate, extract, index, learn, quality, retrieve
from quillspark.sources import tables


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).first()[0]


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_fusion(spark):
    row = lambda ids: spark.createDataFrame([(0, 1, c, i + 1) for i, c in enumerate(ids)], "corpus_key int, query_id int, chunk_id string, rank int")
    found = [(r["chunk_id"], r["score"]) for r in retrieve.fuse([row("ab"), row("bc")]).orderBy("rank").collect()]
    assert [c for c, _ in found] == ["b", "a", "c"]
    assert found[0][1] == pytest.approx(1 / 62 + 1 / 61, abs=1e-9)


def test_windows(spark):
    assert [tuple(w) for w in one(spark, chunk.windows(F.col("n"), 4, 1), n=9)] == [(0, 0, 4), (1, 3, 7), (2, 6, 9)]
    assert one(spark, chunk.windows(F.col("n"), 4, 1), n=0) == []


def test_spans_tell_the_text(spark):
    docs = spark.createDataFrame([(1, " é a  bb\n\tccc "), (2, ""), (3, None)], "doc_id long, text string")
    spans = chunk.token_spans(docs).join(docs, "doc_id").select("tok", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("t")).orderBy("tok").collect()
    assert [r["t"] for r in spans] == ["é", "a", "bb", "ccc"]
    assert [tuple(m) for m in one(spark, match_spans(F.col("t"), "[0-9]+"), t="é12 x3")] == [(1, 3, "12"), (5, 6, "3")]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_token_distance(spark):
    rng = random.Random(1)
    pairs = [([], []), (["x"], []), (["x", "b", "d"], ["a", "b", "c", "d"])] + [([rng.choice("abc") for _ in range(rng.randrange(9))], [rng.choice("abc") for _ in range(rng.randrange(9))]) for _ in range(40)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    found = {r["i"]: r["d"] for r in df.select("i", text.token_distance(F.col("a"), F.col("b")).alias("d")).collect()}
    assert found == {i: distance(a, b) for i, (a, b) in enumerate(pairs)}
    assert one(spark, evaluate.edit_distance(F.col("p"), F.col("g")), p="x b d", g="a b c d") == 0.5


@pytest.mark.parametrize(("before", "after", "kind"), [("", "t", "addition"), ("t", "", "deletion"), ("Mortgage exists", "Mortgage at Book 1", "citation_fix"), ("alpha beta", "alpha beta gamma", "wording"), ("alpha", "omega", "fact_correction")])
def test_edit_types(spark, before, after, kind):
    assert one(spark, text.edit_type(F.col("b"), F.col("a")), b=before, a=after) == kind


def test_confidence(spark):
    assert one(spark, text.page_confidence(F.col("t")), t="") == 0.0
    assert one(spark, text.page_confidence(F.col("t")), t="a" * 800) == 0.98


def test_idf(spark):
    chunks = spark.createDataFrame([(0, 1, "a b"), (0, 2, "b")], "corpus_key int, chunk_id int, text string")
    found = {r["token"]: r["idf"] for r in index.idf(index.postings(chunks), index.corpus_size(chunks)).collect()}
    assert found["a"] == pytest.approx(math.log(2))


def test_order_of_rows_changes_nothing(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet").select(F.lit(0).alias("corpus_key"), F.col("doc_id").alias("chunk_id"), "text")
    queries = spark.read.parquet(f"{TINY}/benchmark.parquet").select(F.lit(0).alias("corpus_key"), F.col("item_id").alias("query_id"), "text")
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(retrieve.hybrid(docs, queries)) == key(retrieve.hybrid(docs.orderBy(F.rand(1)).repartition(5), queries.repartition(3)))


def test_measures_at_their_ends(spark):
    gold = spark.createDataFrame([(1, None, None), (2, "d", 1)], "query_id int, doc_id string, page int")
    hits = spark.createDataFrame([(2, 1, "d", 9, "## Page 1 text")], "query_id int, rank int, doc_id string, page int, text string")
    assert {r["query_id"]: r["recall"] for r in evaluate.recall_at_k(gold, hits).collect()} == {1: 1.0, 2: 1.0}
    claims = spark.createDataFrame([("k", 1, "alpha gamma"), ("k", 2, "")], "key string, claim_id int, text string")
    none = spark.createDataFrame([], "key string, hit_id int, text string")
    assert evaluate.faithfulness(claims, none).first()["faithfulness"] == 0.0
    assert evaluate.faithfulness(claims, spark.createDataFrame([("k", 1, "alpha")], "key string, hit_id int, text string")).first()["faithfulness"] == 0.5


def test_upsert_is_idempotent(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "id string, seq int")
    once = tables.upsert(rows, rows.limit(0), ["id"], [F.desc("seq")])
    twice = tables.upsert(once, rows, ["id"], [F.desc("seq")])
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect())) == [("a", 2), ("b", 1)]


def test_extraction_on_a_commitment(spark):
    t = "Commitment. Effective Date: January 5, 1996. Proposed Insured: Jane Roe\nPolicy Amount: $1,250.50. By Ann Lee  of Wayne, to Bob Ray, grantee. " + "Further text. " * 20 + "Mortgage in favor of First Bank; recorded in Deed Book 12, Page 34 for $900.00, satisfied. Ref 19960105-00012."
    c = F.col("text")
    docs = spark.createDataFrame([(1, t)], "doc_id long, text string").withColumn("people", extract.parties(c))
    row = docs.select(extract.effective_date(c).alias("d"), extract.proposed_insured(c).alias("i"), extract.money(c).alias("m")).first()
    assert (str(row["d"]["value"]), row["i"]["value"], float(row["m"]["value"])) == ("1996-01-05", "Jane Roe", 1250.5)
    assert t[row["d"]["source"]["start"] : row["d"]["source"]["end"]] == row["d"]["source"]["snippet"] == "Effective Date: January 5, 1996"
    lien = extract.listed(docs, extract.liens(F.lit("survey"), F.col("people"), c)).first()
    assert (lien["lien_type"], lien["status"], float(lien["amount"]), lien["creditor"]) == ("mortgage", "released", 900.0, "First Bank")
    assert [(r["name"], r["role"]) for r in extract.listed(docs, F.col("people")).orderBy("ordinal").collect()][:2] == [("Ann Lee", "grantor"), ("Bob Ray", "grantee")]
    assert extract.listed(docs, extract.references(c)).count() == 2


def test_discrimination_is_a_word(spark):
    texts = ["Declaration of covenants of record in Colorado.", "Deed restrictions of the terrace without a trace", "Deed restrictions on race", "Deed restrictions, FAIR HOUSING ACT"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["discriminatory"] for r in extract.listed(docs, extract.restrictions(F.col("text"))).collect()} == {0: False, 1: False, 2: True, 3: True}


def test_words_of_any_script(spark):
    assert one(spark, text.content_tokens(F.col("t")), t="Größe größe über Ещё слово the with 日本語文 a_b1") == ["größe", "über", "слово", "日本語文", "a_b1"]
    assert one(spark, text.page_confidence(F.col("t")), t="ß" * 800) == 0.98
    assert one(spark, evaluate.edit_distance(F.col("p"), F.col("g")), p="Owner: John.", g="owner john") == 0.0
    assert one(spark, evaluate.edit_distance(F.col("p"), F.col("g")), p="a b", g="") == 1.0


def test_rules_without_words_do_not_apply(spark):
    rules_ = spark.createDataFrame([("k", "r1", "the of"), ("k", "r2", "cite book page")], "key string, rule_id string, text string")
    row = evaluate.rule_application(rules_, spark.createDataFrame([("k", "Book and page")], "key string, text string")).first()
    assert (row["n_rules"], row["n_applicable"], row["rate"]) == (2, 1, 1.0)


def test_special_warranty_deed_is_a_warranty_deed(spark):
    from quillspark.functions.rules import INSTRUMENTS

    assert one(spark, text.first_match(F.col("t"), INSTRUMENTS, ""), t="A Special Warranty Deed") == "warranty_deed"


def test_rules_version_up(spark):
    events = spark.createDataFrame([("s1", i, "old", "old indemnity clause", "addition") for i in range(25)], "section string, seq int, before string, after string, edit_type string")
    first = learn.distilled(events, spark.createDataFrame([], "section string, version int"))
    again = learn.distilled(events, first.select("section", "version")).first()
    assert again["version"] == 2
    assert [(r["id"], r["triggers"]) for r in again["rules"]] == [("r1", ["wording", "style"]), ("r4", ["addition"])]
    assert learn.last_events(events).count() == 20


def test_drafting(spark):
    sentences = spark.createDataFrame([("k", 0, "the owner holds title here")], "key string, ordinal int, text string")
    path, like = draft.SUMMARY, "owner holds title here"
    rows = [("k", 4, path, "owner holds title", "second"), ("k", 3, path, like, "first"), ("k", 0, path, "nothing alike", "no"), ("k", 1, path, like, "  "), ("k", 2, "gaps[0]", like, "no")]
    edits = spark.createDataFrame(rows, "key string, seq int, field_path string, before string, after string")
    assert draft.adopted(sentences, edits).first()["text"] == "first"
    cut = one(spark, draft.snippet(F.col("t"), F.array(F.lit("needle"))), t="x" * 500 + "needle" + "y" * 500)
    assert (cut["start"], cut["end"]) == (280, 720) and "needle" in cut["snippet"]
    risk = spark.createDataFrame([(1, "green", 0, 0), (2, "yellow", 0, 0), (3, "green", 0, 1)], "matter_id int, flag string, n_gaps int, n_open_liens int")
    assert {r[0]: r[1] for r in draft.overall_risk(risk).collect()} == {1: "clear_to_close", 2: "curable_issues", 3: "material_issues"}


def test_rescue(spark):
    pages = spark.createDataFrame([(1, 1, "short"), (1, 2, "w" * 90)], "doc_id int, page int, text string")
    assert quality.rescue_gate(pages).first()["rescue"]
    better = quality.rescued(pages, spark.createDataFrame([(1, 1, "a longer text"), (1, 2, "x")], "doc_id int, page int, text string")).orderBy("page").collect()
    assert [r["rescued"] for r in better] == [True, False]


def test_model_hooks(spark):
    asked = spark.createDataFrame([("a",), ("b",), ("a",)], "prompt string")
    cached = asked.where("prompt = 'a'").select(tables.cache_key(F.col("prompt")).alias("key"), F.lit("known").alias("answer")).distinct()
    assert sorted((r["answer"], r["cached"]) for r in models.generate(asked, cached, lambda: lambda p: p.upper()).collect()) == [("B", False), ("known", True)]
    assert {r["answer"] for r in models.generate(asked, cached, None).collect()} == {"known", None}
    assert one(spark, models.json_object(F.col("t")), t='so:\n```json\n{"a": 1}\n``` ok') == '{"a": 1}'
    now = [0.0]

    def limited(_):
        raise RuntimeError("429 rate limit, retry after 30s")

    walk = models.Walk([("x", limited), ("y", lambda p: p + "!")], clock=lambda: now[0], sleep=lambda s: None)
    assert walk("hi") == ("hi!", "y") and walk.resting["x"] == 30.0
    assert models.available([("a", None), ("b", "<key>"), ("c", "k")]) == ["c"]


def test_streaming_log(spark, tmp_path):
    from quillspark.sources.keyed import KeyedTable
    from quillspark.streaming import edit_log

    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    spark.createDataFrame([("e1", "s1", "2024-01-01 00:00:00", 1), ("e2", "s1", "2024-01-01 00:01:00", 2), ("e1", "s1", "2024-01-01 00:02:00", 3)], "edit_id string, section string, created_at string, seq long").withColumn("created_at", F.to_timestamp("created_at")).write.parquet(log)
    schema = spark.read.parquet(log).schema
    store = KeyedTable(spark, out, "edit_id string, section string, created_at timestamp, seq long", ("edit_id",), ("created_at",), 4)
    q = edit_log.merge_into(edit_log.read(spark, log, schema, "parquet"), store, str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sorted((r["edit_id"], r["seq"]) for r in store.read().collect()) == [("e1", 3), ("e2", 2)]
    q = edit_log.unique(edit_log.read(spark, log, schema, "parquet")).writeStream.format("memory").queryName("uniq").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("uniq").count() == 2


def test_a_long_legal_description_is_kept(spark):
    calls = " ".join(f"thence North {k} degrees East {k} feet to an iron pin;" for k in range(100, 200))
    rows = [(1, f"Legal description: {calls}"), (2, f"Legal description: {calls[:2500]}\n\nSchedule B"), (3, f"Legal description: {calls[:300]}\n\nSchedule B")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["t"] for r in docs.select("doc_id", extract.legal_description(F.col("text"))["text"].alias("t")).collect()}
    assert len(calls) > 3800
    assert found == {1: calls[:2000], 2: calls[:2000], 3: calls[:300].strip(" .,;:-")}
