"""Readers, fallbacks and sinks with stand-in parsers and clients."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quillspark import cli
from quillspark.operators import learn, quality
from quillspark.sources import pages, tables


def test_parse(spark, tmp_path):
    def halves():
        def parse(content: bytes) -> list[str]:
            if content == b"bad":
                raise ValueError("no")
            return content.decode().split("|")

        return parse

    (tmp_path / "one.txt").write_bytes(b"first| ")
    (tmp_path / "two.txt").write_bytes(b"bad")
    rows = {(r["doc_id"], r["page"]): r for r in pages.parse(pages.binary_files(spark, str(tmp_path / "*.txt")), halves, "halves").collect()}
    assert rows["one", 1]["text"] == "first" and rows["one", 2]["warnings"] == ["empty page"]
    assert rows["two", 0]["text"] is None and rows["two", 0]["warnings"] == ["halves failed: ValueError"]


def test_fallback(spark):
    keys = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "doc_id string")
    first = spark.createDataFrame([("a", "x" * 300), ("b", "short")], "doc_id string, text string")
    second = spark.createDataFrame([("a", "y" * 300), ("b", "z" * 300), ("c", "little")], "doc_id string, text string")
    assert {r["doc_id"]: r["reader"] for r in pages.fallback(keys, first, second).collect()} == {"a": 0, "b": 1, "c": 1, "d": None}


def test_vector_sink(spark, tmp_path):
    where = str(tmp_path)

    def client():
        import uuid

        return lambda rows: open(f"{where}/{uuid.uuid4().hex}.json", "w").write(json.dumps([r["id"] for r in rows]))

    pages.write_vectors(spark.range(250).coalesce(1), client)
    sent = [json.loads(p.read_text()) for p in tmp_path.iterdir()]
    assert sorted(map(len, sent)) == [50, 100, 100] and sorted(x for s in sent for x in s) == list(range(250))


def test_json_log(spark, tmp_path):
    schema = StructType([StructField("id", LongType()), StructField("note", StringType())])
    assert tables.read_or_empty(spark, str(tmp_path / "none"), schema).count() == 0
    tables.write_json(spark.createDataFrame([(1, "a"), (2, None)], schema), str(tmp_path / "log"))
    (tmp_path / "log" / "more.json").write_text('{"id": 3}\n\nnot json\n')
    rows = tables.read_json(spark, str(tmp_path / "log" / "*.json"), schema)
    assert sorted(r["id"] for r in rows.where("id is not null").collect()) == [1, 2, 3]
    keys = spark.range(1, 4).withColumnRenamed("id", "k")
    found = tables.preferred(keys, rows.select(F.col("id").alias("k"), "note"), spark.createDataFrame([(2, "b")], "k long, note string"), "k", "note")
    assert {r["k"]: r["note"] for r in found.collect()} == {1: "a", 2: "b"}


def test_simulated_edits_keep_the_class_they_were_made_as(spark):
    """One-word texts share nothing with what they become: by the texts alone the change of a word was a correction of a fact."""
    edits = pages.simulated_edits(spark.createDataFrame([(1, "s1", 0, "word"), (1, "s1", 1, "word"), (1, "s1", 2, "word"), (1, "s1", 3, "Book and page"), (1, "s1", 4, "Indeed so")], "matter_id int, section string, ordinal int, text string"))
    side = lambda c, *more: edits.select("matter_id", "section", "field", "ordinal", edits[c].alias("text"), *more)
    rows = learn.diff(side("before"), side("after", "made")).orderBy("field_path").collect()
    assert [r["edit_type"] for r in rows] == ["citation_fix", "wording", "deletion", "wording", "wording"]
    assert {r["edit_type"] for r in learn.diff(side("before"), side("after")).where("field_path = 'summary[1].text'").collect()} == {"fact_correction"}


def test_simulated_edits(spark):
    rows = pages.simulated_edits(spark.createDataFrame([(1, "s1", i, "some text") for i in range(3)], "matter_id int, section string, ordinal int, text string")).orderBy("ordinal").collect()
    assert [r["after"] for r in rows] == ["some text See Book 1, Page 0.", "Revised text", ""]


def test_cli(spark, tmp_path, capsys):
    assert cli.main(["list"]) == 0 and "hybrid_search_top5" in capsys.readouterr().out
    assert cli.main(["run", "section_dimension", "/root/testdata/sf0.001", "--out", str(tmp_path / "out")]) == 0
    assert spark.read.json(str(tmp_path / "out")).count() == 8


def test_intake(spark):
    """Only what is asked for is read again, the longer text of a page stays, and what nothing reads is a document without pages."""
    long, cut = "A page with a good deal of text, far over sixty characters, which is kept.", "cut"
    names = spark.createDataFrame([("a", "a"), ("b", "b"), ("c", "c"), ("d", "d"), ("e", "e-handwritten")], "doc_id string, name string")
    of = lambda rows: spark.createDataFrame(rows, "doc_id string, page int, text string, warnings array<string>")
    first = of([("a", 1, long, []), ("a", 2, cut, ["empty page"]), ("b", 0, None, ["failed"]), *(("c", i, cut if i == 3 else long, []) for i in range(1, 6)), ("d", 1, "", []), ("e", 1, long, []), ("e", 2, long, [])])
    asked = {}

    def again(wanted):
        asked.update({r["doc_id"]: r["wanted"] for r in wanted.collect()})
        return of([("a", 2, long + " more", []), ("b", 1, long, []), ("b", 2, long, []), ("d", 0, None, ["failed too"])])

    transcripts = spark.createDataFrame([("e", 2, "In my own hand.")], "doc_id string, page int, text string")
    out = {r["doc_id"]: r for r in quality.intake(names, first, again, transcripts, most=4).collect()}
    assert asked == {"a": [2], "b": None, "d": None}  # a page in five of c is too few
    shown = lambda i: [(p["page"], p["parser"], p["text"]) for p in out[i]["pages"]]
    assert shown("a") == [(1, "text_layer", long), (2, "ocr", long + " more")] and out["a"]["pages"][1]["warnings"] == []
    assert shown("b") == [(1, "ocr", long), (2, "ocr", long)] and out["b"]["parsers"] == ["ocr"] and out["b"]["warnings"] == ["failed"]
    assert [p for p, *_ in shown("c")] == [1, 2, 3, 4] and out["c"]["parsers"] == ["text_layer"] and out["c"]["warnings"] == ["5 pages, of which the first 4 are kept", "1 sparse pages of 4 stay as they are"]
    assert shown("d") == [(1, "text_layer", "")] and out["d"]["warnings"] == ["failed too"]
    assert shown("e") == [(1, "text_layer", long), (2, "transcript", "In my own hand.")] and out["e"]["parsers"] == ["text_layer", "transcript"]
    assert [(p["classification"], p["confidence"]) for p in out["e"]["pages"]] == [("handwritten", pytest.approx(0.4)), ("handwritten", 0.95)] and out["e"]["warnings"] == ["page 1 is handwritten and has no transcript"]
    assert out["b"]["markdown"] == f"## Page 1\n\n{long}\n\n## Page 2\n\n{long}"
    assert quality.intake(names.limit(0), first.limit(0), lambda w: first.limit(0), transcripts).count() == 0


def test_wanted_pages_only(spark):
    files = spark.createDataFrame([("a", b"1|2|3"), ("b", b"1|2"), ("c", b"1")], "doc_id string, content binary")
    asked = spark.createDataFrame([("a", [2, 9]), ("b", None)], "doc_id string, wanted array<int>")
    found = pages.parse(files, lambda: lambda c: c.decode().split("|"), "p", asked).collect()
    assert sorted((r["doc_id"], r["page"], r["text"]) for r in found) == [("a", 2, "2"), ("b", 1, "1"), ("b", 2, "2")]


def test_intake_shuffles_pages_as_documents(spark):
    """What is read is shuffled once as pages and once as documents: no join or grouping is by page."""
    pages = spark.createDataFrame([("a", 1, "x", ["w"]), ("a", 2, "long enough to stay as it is " * 4, None)], "doc_id string, page int, text string, warnings array<string>")
    names, scripts = spark.createDataFrame([("a", "a")], "doc_id string, name string"), spark.createDataFrame([], "doc_id string, page int, text string")
    out = quality.intake(names, pages, lambda asked: pages.where("page = 1").withColumn("text", F.lit("y" * 70)), scripts)
    assert [(p["page"], p["parser"], len(p["text"])) for p in out.first()["pages"]] == [(1, "ocr", 70), (2, "text_layer", 116)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any("page#" in line for line in plan.splitlines() if "hashpartitioning" in line)
