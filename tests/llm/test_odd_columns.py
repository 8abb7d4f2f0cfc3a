"""Operators on tables whose columns have the names of their own results, and on very long texts."""

from pyspark.sql import functions as F

from quillspark.llm import htmltext, langid, mixing, simhash


def test_mixing_odd_columns_and_long_texts(spark):
    """Columns of the operator's own names stay out of its way, and a very long text counts whole."""
    rows = [(i, "w " * (10 + i % 7), "ab"[i % 2], "x", 1, 2.0, 3) for i in range(200)] + [(900, "long " * 400_000, "a", "x", 1, 2.0, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string, copies int, target double, taken int")
    out = {r["doc_id"]: r for r in mixing.mix(df).collect()}
    assert set(out) == {r[0] for r in rows} and out[900]["size"] == 400_000
    assert all(r["size"] == len(t.split()) and r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3 for i, t, *_ in rows for r in [out[i]])
    plain = {r["doc_id"]: r for r in mixing.mix(df.select("doc_id", "text", "source")).collect()}
    assert out == plain


def test_language_keeps_to_its_columns(spark):
    """Columns named as the results don't reach a prediction."""
    rows = [(i, t, None if i % 5 == 0 else ln) for i, (t, ln) in enumerate([("the cat and the dog ran home", "en"), ("der Hund und die Katze liefen heim", "de")] * 40)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    named = plain.withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit("zz")).withColumn("held_out", F.lit(7))
    model = langid.fit(plain)
    found = lambda df: sorted(map(tuple, langid.identify(df, model).select("doc_id", "lang_pred", "score").collect()))
    assert found(plain.select("doc_id", "text")) == found(named.select("doc_id", "text"))


def test_near_duplicates_of_very_long_texts(spark):
    """Whole texts decide: two of 300,000 words that differ in the last ones only, and one that differs everywhere; columns of the results' names aren't read."""
    long = " ".join(f"w{i}" for i in range(300_000))
    rows = [(1, long), (2, long + " end"), (3, " ".join(f"v{i}" for i in range(300_000))), (4, long)]
    df = spark.createDataFrame([(*r, 0, "x", -1) for r in rows], "doc_id long, text string, fp int, component_id string, node int")
    found = {r["doc_id"]: r for r in simhash.near_duplicates(df).collect()}
    assert {i: simhash.fingerprint(t.encode(), 3) for i, t in rows} == {i: r["fp"] % 2**64 for i, r in found.items()}
    assert found[4]["component_id"] == 1 and found[3]["component_id"] == 3
    near = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df, 5, similarity=0.8).collect()}
    assert near == {1: 1, 2: 1, 3: 3, 4: 1}


def test_pages_of_very_long_texts(spark):
    """One block of two million characters comes out whole; columns of the results' names aren't read."""
    long = "word " * 400_000
    df = spark.createDataFrame([(1, "u", f"<nav><a href='/'>Home</a></nav><article><h1>Title</h1><p>{long}</p></article><footer>&copy; us</footer>", "x", "y")], "page_id long, url string, html string, text string, n_chars string")
    row = htmltext.extract(df).first()
    assert row["text"] == "Title\n" + long.strip() and row["n_chars"] == len(row["text"])
