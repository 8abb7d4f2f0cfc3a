"""Keyed tables, streams into them, segments of the edit index, nested values, measures, packed documents, and spans in linear time."""

import os
import random
import re
import time

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspark.functions import nested, spans
from quillspark.functions.text import needed
from quillspark.observe import Measures
from quillspark.operators import chunk, extract
from quillspark.sources import tables
from quillspark.sources.keyed import KeyedTable
from quillspark.sources.segments import EditIndex, rebuilt
from quillspark.streaming import edit_log

ROW = "k string, seq long, v string"


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_upserts_rewrite_touched_buckets_only(spark, tmp_path):
    store = KeyedTable(spark, str(tmp_path), ROW, ("k",), ("seq",), 8)
    assert store.read().count() == 0 and store.manifest().version == 0
    store.upsert(spark.createDataFrame([(f"k{i}", 1, "a") for i in range(60)] + [(None, 1, "n")], ROW))
    before, folders = files(tmp_path), store.manifest().folders
    assert len(folders) == 8
    store.upsert(spark.createDataFrame([("k3", 2, "b"), ("k3", 2, "c"), ("k5", 0, "old")], ROW))
    after = store.manifest()
    changed = {b for b in folders if folders[b] != after.folders[b]}
    assert 1 <= len(changed) <= 2 and all(files(tmp_path)[f] == t for f, t in before.items())
    rows = {r["k"]: (r["seq"], r["v"]) for r in store.read().collect()}
    assert len(rows) == 61 and rows["k3"] == (2, "c") and rows["k5"] == (1, "a") and rows[None] == (1, "n")
    found = store.lookup(spark.createDataFrame([("k3",), ("none",)], "k string"))
    assert [r["v"] for r in found.collect()] == ["c"] and len(found.inputFiles()) <= 2
    store.upsert(spark.createDataFrame([], ROW))
    assert store.read().count() == 61


def test_batches_come_once_and_rivals_fail(spark, tmp_path):
    store = KeyedTable(spark, str(tmp_path), ROW, ("k",), ("seq",), 4)
    one = spark.createDataFrame([("a", 1, "x")], ROW)
    assert store.upsert(one, "s", 0) and not store.upsert(spark.createDataFrame([("a", 9, "again")], ROW), "s", 0)
    assert store.upsert(one, "other", 0) and [r["v"] for r in store.read().collect()] == ["x"]
    held = store.manifest()
    late = KeyedTable(spark, str(tmp_path), ROW, ("k",), ("seq",), 4)
    object.__setattr__(late, "manifest", lambda: type(held)(held.version - 1, held.folders, held.batches))
    try:
        late.upsert(one)
        raise AssertionError("a writer that started from an older version must fail")
    except Exception as e:
        assert "already exists" in str(e).lower() or "PATH_ALREADY_EXISTS" in str(e)
    assert store.manifest().version == held.version


def test_streams_into_a_keyed_table(spark, tmp_path):
    source, where = str(tmp_path / "in"), str(tmp_path / "table")
    spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], ROW).coalesce(1).write.parquet(source)
    store = KeyedTable(spark, where, ROW, ("k",), ("seq",), 4)
    run = lambda cp: edit_log.merge_into(edit_log.read(spark, source, StructType.fromDDL(ROW), "parquet"), store, str(tmp_path / cp)).awaitTermination()
    run("one")
    spark.createDataFrame([("a", 2, "z")], ROW).coalesce(1).write.mode("append").parquet(source)
    run("one")
    version = store.manifest().version
    run("one")  # nothing new
    held = store.manifest().batches
    assert store.manifest().version == version and len(held) == 1 and not store.upsert(spark.createDataFrame([("a", 9, "again")], ROW), *next(iter(held.items())))
    spark.createDataFrame([("c", 1, "w")], ROW).coalesce(1).write.mode("append").parquet(source)
    run("two")  # a lost checkpoint: all files come again, in other batches, with a new one among them
    assert {(r["k"], r["v"]) for r in store.read().collect()} == {("a", "z"), ("b", "y"), ("c", "w")}


def test_last_edits_in_state(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = StructType.fromDDL("section string, seq long, edit_id string")
    feed = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    lists = lambda: {r["section"]: r["edit_ids"] for r in edit_log.latest_lists(spark, edit_log.last_per_section(edit_log.read(spark, source, schema, "parquet"), 3), str(tmp_path / "t"), str(tmp_path / "cp")).collect()}
    feed([("a", i, f"e{i}") for i in range(200)] + [("b", 1, "f")])
    assert lists() == {"a": ["e197", "e198", "e199"], "b": ["f"]}
    feed([("a", 198, "e198"), ("a", 5, "late"), ("a", 300, "new")])
    assert lists() == {"a": ["e198", "e199", "new"], "b": ["f"]}


def test_segments_find_what_an_index_made_anew_finds(spark, tmp_path):
    rng = random.Random(3)
    schema = "edit_id string, matter_id string, section string, field_path string, edit_type string, before string, after string"
    make = lambda i, v: (f"e{i}", f"m{i % 3}", f"s{i % 2}", "summary[0].text", "wording", "old", " ".join(rng.choices("lien deed tax lot book page easement grant".split(), k=4)) + v)
    first, second, third = ([make(i, v) for i in ids] for ids, v in ((range(60), ""), (range(30, 70), " twice"), (range(65, 90), "")))
    index = EditIndex(spark, str(tmp_path / "a"))
    assert index.last() == 0 and index.search(spark.createDataFrame([("q", "s0", "lien")], "query_id string, section string, text string")).count() == 0
    for part in (first, second, third):
        index.append(spark.createDataFrame(part, schema))
    index.delete(spark.createDataFrame([(f"e{i}", f"s{i % 2}") for i in (3, 40, 70)], "edit_id string, section string"))
    kept = {r[0]: r for part in (first, second, third) for r in part if r[0] not in ("e3", "e40", "e70")}
    anew = rebuilt(spark, str(tmp_path / "b"), [spark.createDataFrame(list(kept.values()), schema)])
    asked = spark.createDataFrame([("q0", "s0", "lien deed twice"), ("q1", "s1", "tax lot book"), ("q2", "s1", "page")], "query_id string, section string, text string")
    shown = lambda x, **how: sorted((r["query_id"], r["rank"], r["edit_id"], r["score"]) for r in x.search(asked, 5, **how).collect())
    assert shown(index) == shown(anew) and len(shown(index)) == 15
    assert shown(index, matter="m1") == shown(anew, matter="m1")
    whole = index.compact(str(tmp_path / "c"))
    assert whole.last() == 1 and shown(whole) == shown(anew) and {r["edit_id"] for r in whole.current().collect()} == set(kept)
    assert "s1" not in str(index.current(["s0"]).select("section").distinct().collect())


def test_coercion_loses_what_does_not_fit_only(spark):
    kind = StructType.fromDDL("a int, s struct<d:date,name:string>, l array<struct<n:int,t:array<string>>>, x double")
    rows = ['{"a": 1, "s": {"d": "2001-02-03", "name": "q"}, "l": [{"n": 1, "t": ["u", "v"]}, {"n": "bad", "t": 5}, 7], "x": 1.5}', '{"a": "zz", "s": 4, "l": {"n": 1}, "x": null}', "[1]", "nope", None, "{}"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, j string").select("i", nested.parsed(F.col("j"), kind).alias("p"))
    found = {r["i"]: r["p"] for r in df.collect()}
    value = found[0]["value"].asDict(True)
    assert value["a"] == 1 and str(value["s"]["d"]) == "2001-02-03" and value["l"] == [{"n": 1, "t": ["u", "v"]}, {"n": None, "t": None}] and found[0]["failing"] == ["l[1].n", "l[1].t", "l[2]"]
    assert found[1]["failing"] == ["a", "s", "l"] and found[1]["value"]["x"] is None and found[2]["value"] is None and found[2]["failing"] == [""] and found[3] is None and found[4] is None and found[5]["failing"] == []
    at = lambda p: df.where("i = 0").select(nested.at(F.col("p.value"), kind, p)).first()[0]
    assert at("s.name") == "q" and at("l.n") == [1, None] and at("l.t") == ["u", "v"]


def test_measures_come_with_the_job(spark):
    seen = Measures("t1")
    df = seen.of(spark.createDataFrame([(1, "a", 0.5), (2, None, None)], "n long, s string, x double"), "in")
    assert df.count() == 2
    rows = {(r["measure"], r["column"]): r["value"] for r in seen.table(spark).collect()}
    assert rows == {("rows", ""): 2, ("nulls", "n"): 0, ("nulls", "s"): 1, ("nulls", "x"): 1, ("sum", "n"): 3, ("sum", "x"): 0.5}


def test_named_documents_share_files(spark, tmp_path):
    docs = spark.createDataFrame([(f"{i:04}", f"v{i}", None if i % 2 else i) for i in range(2000)], "doc_id string, v string, n int")
    tables.write_named(docs, str(tmp_path), "title_document")
    assert len([f for f in os.listdir(tmp_path) if f.endswith(".parquet")]) <= 4
    some = tables.read_named(spark, str(tmp_path), "00?1.title*", docs.schema)
    assert sorted(r["doc_id"] for r in some.collect()) == [f"00{i}1" for i in range(10)]
    assert "StringStartsWith(name,00)" in some._jdf.queryExecution().toString()
    one = tables.read_named(spark, str(tmp_path), "0017.title_document.json", docs.schema).collect()
    assert [(r["v"], r["n"], r["name"]) for r in one] == [("v17", None, "0017.title_document.json")]


def test_three_extractions(spark):
    schema = "doc_id int, a string, b double, l array<string>"
    docs = spark.range(5).select(F.col("id").cast("int").alias("doc_id"))
    label = spark.createDataFrame([(1, "fa", None, []), (2, None, 2.0, ["f"])], schema)
    ruled = spark.createDataFrame([(1, "ra", 1.0, ["r"]), (2, "ra", 9.0, ["r"]), (3, "ra", None, ["r"])], schema)
    model = spark.createDataFrame([(1, None, 5.0, ["m"]), (3, "ma", 3.0, []), (4, "ma", None, [])], schema)
    rows = {r["doc_id"]: r.asDict() for r in extract.composed(docs, label, ruled, model, ["a", "b"], ["l"]).collect()}
    show = lambda i: (rows[i]["a"], rows[i]["b"], rows[i]["l"], rows[i]["chosen"], rows[i]["sources"], rows[i]["agreed"])
    assert show(1) == ("fa", 1.0, ["r"], {"a": "fixture", "b": "rules", "l": "rules"}, ["fixture", "rules", "model"], False)
    assert show(2) == ("ra", 2.0, ["f"], {"a": "rules", "b": "fixture", "l": "fixture"}, ["fixture", "rules"], False)
    assert show(3) == ("ma", 3.0, ["r"], {"a": "model", "b": "model", "l": "rules"}, ["rules", "model"], False)
    assert show(4) == ("ma", None, [], {"a": "model"}, ["model"], None) and rows[0]["sources"] == [] and rows[0]["l"] is None


def test_spans_and_first_keys(spark):
    texts = ["", "no", "Book 1, Page 2 and book 3, page 4", "\x01Book 1, Page 2\x01x", "é Book A, Page B" * 3]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    p = r"(?i)book\s+([a-z0-9]+),\s+page\s+([a-z0-9]+)"
    for r in df.select("t", spans.match_spans(F.col("t"), p).alias("m")).collect():
        assert [(x["start"], x["end"], x["match"]) for x in r["m"]] == [(m.start(), m.end(), m[0]) for m in re.finditer(p, r["t"])]
    firsts = spark.createDataFrame([(["b", "a", "b", None, "c", "a", None],), ([],)], "x array<string>").select(spans.first_by(F.col("x"), lambda c: c).alias("f")).collect()
    assert [r["f"] for r in firsts] == [["b", "a", None, "c"], []]
    body = "".join(chr(97 + i % 26) for i in range(5000)) + "é😀" * 50
    cut = spark.createDataFrame([(body,)], "t string").select(spans.let(spans.blocks(F.col("t")), lambda b: F.array(*(spans.between(b, F.lit(s), F.lit(e)) for s, e in ((0, 3), (1000, 1030), (1023, 1024), (1024, 1024), (900, 4100), (5001, 9999))))).alias("c")).first()["c"]
    assert cut == [body[0:3], body[1000:1030], body[1023:1024], "", body[900:4100], body[5001:]]


def test_needed_words():
    assert needed(r"\bdeed\s+of\s+trust\b") == ["trust"] and needed(r"(?:executed\s+by|from)\s+x") == ["executed", "from"] and needed(r"\bcc&?r\b|abcd") is None
    assert needed(r"ab(?:cde)?fgh") == ["fgh"] and needed(r"trustee'?s?\s+deed") == ["trustee"] and needed(r"[abc]+") is None


def test_linear_time(spark):
    def seconds(df):
        began = time.time()
        df.write.format("noop").mode("overwrite").save()
        return time.time() - began

    base = spark.createDataFrame([(1,)], "doc_id long")
    words = lambda n: chunk.chunks(base.select("doc_id", F.expr(f"repeat('some words here Page 7 and ', {n // 6})").alias("text")), 600, 80, None)
    people = F.array().cast("array<struct<name:string,role:string,is_entity:boolean>>")
    links = lambda n: base.select(extract.chain(F.lit("survey"), people, F.expr(f"array_join(transform(sequence(1, {n}), i -> concat('a Mortgage by Carl Moss to Ann Lee in Book ', i, ', Page 7; it is recorded. ')), '')")))
    for made, small, large in ((words, 40_000, 160_000), (links, 1000, 4000)):
        seconds(made(100))
        one = min(seconds(made(small)) for _ in range(2))
        assert seconds(made(large)) < 6 * max(one, 0.3)


def test_sections_in_the_order_of_the_log(spark):
    from quillspark.operators import learn

    log = spark.createDataFrame([("b", 3), ("a", 5), ("c", 1), ("b", 9)], "section string, seq int")
    assert [(r["section"], r["place"]) for r in learn.sections_in_order(log).orderBy("place").collect()] == [("c", 1), ("b", 2), ("a", 3)]
    assert learn.sections_in_order(log.limit(0)).count() == 0


def test_queries_of_every_corpus(spark):
    """Queries without a corpus find what the same queries find that are repeated for each."""
    from quillspark.operators import retrieve

    rng = random.Random(6)
    words = "lien deed tax lot book page easement grant vested owner".split()
    chunks = spark.createDataFrame([(k, f"c{i}", " ".join(rng.choices(words, k=rng.randrange(1, 12)))) for k in (1, 2, 3) for i in range(12)] + [(4, "c0", "")], "corpus_key int, chunk_id string, text string")
    asked = spark.createDataFrame([(0, "vested owner lien"), (1, "tax book page none")], "query_id int, text string")
    repeated = chunks.select("corpus_key").distinct().join(asked)
    shown = lambda q: sorted(map(tuple, retrieve.hybrid(chunks, q).select("corpus_key", "query_id", "chunk_id", "score", "rank").collect()))
    assert shown(asked) == shown(repeated) and len(shown(asked)) == 30


def test_spread_deals_rows_out(spark):
    """A table of small rows is one file: tasks are as many as its rows ask for, not one for each core."""
    few, many = tables.spread(spark.range(3).coalesce(1), 10), tables.spread(spark.range(1000).coalesce(1), 10)
    assert few.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert many.rdd.getNumPartitions() == 100 and many.count() == 1000


def test_words_that_spare_a_search(spark):
    """Short words count where a pattern has no others; what they spare the text has not."""
    from quillspark.functions.text import may_hold

    assert needed(r"\bby\s+([A-Z]+)\s+(?:of|to)\b", 2) == ["by"] and needed(r"\bcc&?r\b", 2) == ["cc"]
    assert may_hold(F.lit("x"), r"\d+") is None
    row = spark.createDataFrame([("Deed BY Ann Lee and wife Ida Moss  of Wayne. Parcel ID 7-A. LEGAL\nDescription: Lot 5 of the plat of some long and winding road, Schedule \n B, more",)], "t string")
    out = row.select(extract.parties(F.col("t")).alias("p"), extract.legal_description(F.col("t")).alias("l")).first()
    assert [(p["name"], p["role"]) for p in out["p"]] == [("Ann Lee", "grantor"), ("Ida Moss", "grantor")]
    assert out["l"]["text"] == "Lot 5 of the plat of some long and winding road" and out["l"]["lot"] == "5" and out["l"]["apn"] == "7-A"
