"""The pipeline's stages against brute force over lists, on a table with every oddity and columns of clashing names."""

import collections
import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import corpus_pipeline
from quillspark.llm import mixing, packing, secrets, toxicity

TINY = "/root/testdata/sf0.001"
NAMES = "toxicity passages secrets secrets_ copies id of words size text_hash component_id copy".split()


def sets(text, size=5):
    w = (text or "").split()
    return {" ".join(w[k : k + size]).lower() for k in range(max(1, len(w) - size + 1))} if w else set()


@pytest.fixture(scope="module")
def docs(spark):
    """The table of the smallest size with near copies of its texts, nulls, blanks, a long text, repeated rows and ids, and a column of each name that stages use."""
    rng = random.Random(4)
    rows = [tuple(r) for r in spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    for i, (_, text, lang, source, _) in enumerate(rows[:60]):
        w = (text or "").split()
        for _ in range(max(1, len(w) // 60)):
            if w:
                w[rng.randrange(len(w))] = f"changed{rng.randrange(9)}"
        rows.append((10_000 + i, " ".join(w), lang, source, 1))
    long = " ".join(f"w{rng.randrange(300)}" for _ in range(30_000))
    rows += [(20_001, None, None, None, None), (20_002, "", "en", "web", 0), (20_003, " \n", "en", "web", 2), (20_004, long, "en", "web", len(long)), (20_005, "one two", "en", None, 7), (20_005, "one two", "en", None, 7)]
    rows += [(20_006, "three four five six seven eight", "en", "web", 1), (20_006, "quite another text of this id here", "en", "web", 1), (None, "one two", "en", "web", 7), (None, None, None, None, None)]
    columns = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in NAMES) + ", `dotted.name` int"
    return spark.createDataFrame([(*r, *(f"own {n}" for n in NAMES), 5) for r in rows], columns).repartition(5)


def plain(df):
    return collections.Counter(tuple(r) for r in df.collect())


def test_toxicity_stage(spark, docs):
    kept = plain(corpus_pipeline.drop_toxic(spark, docs, TINY))
    model = toxicity.fit(docs, spark.read.parquet(f"{TINY}/labels.parquet"))
    scorer = toxicity.Scorer(model)
    assert kept == collections.Counter({r: n for r, n in plain(docs).items() if scorer.probability(*scorer(r[1])[:2]) < 0.5})
    assert 0 < sum(kept.values()) < docs.count()


def test_near_duplicates_stage(spark, docs):
    rows = [tuple(r) for r in docs.collect()]
    distinct = sorted({(r[0], r[1]) for r in rows if r[0] is not None}, key=lambda x: (x[0], x[1] or ""))
    found = [sets(t) for _, t in distinct]
    up = list(range(len(distinct)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, x in enumerate(found):
        for j in range(i):
            both = len(x & found[j])
            if x == found[j] or both >= 0.8 * (len(x) + len(found[j]) - both) > 0:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    least = {}
    for i, (doc_id, _) in enumerate(distinct):
        least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    stays = {d for i, d in enumerate(distinct) if least[root(i)] == d[0]}
    kept = plain(corpus_pipeline.drop_near_duplicates(spark, docs, TINY))
    assert {(r[0], r[1]) for r in kept if r[0] is not None} == stays
    assert all(n == 1 for r, n in kept.items() if r[0] is not None)
    assert sum(n for r, n in kept.items() if r[0] is None) == 2
    assert len(stays) < len(distinct) - 30


def test_secrets_stage(spark, docs):
    out = corpus_pipeline.redact_secrets(spark, docs, TINY)
    assert out.columns == docs.columns
    wanted = secrets.redact(docs.select("doc_id", "text"), secrets.fit(secrets.samples(docs)))
    assert plain(out.select("doc_id", "text")) == plain(wanted)
    assert out.where("not (n_chars <=> length(text))").count() == 0 and plain(out.select(*NAMES)) == plain(docs.select(*NAMES))


def test_mixing_stage(spark, docs):
    out = plain(corpus_pipeline.mix_sources(spark, docs, TINY))
    copies = {(r["doc_id"], r["source"], r["size"]): r["copies"] for r in mixing.mix(docs).collect()}
    assert out == collections.Counter({r: n * k for r, n in plain(docs).items() if (k := copies[r[0], r[3], len((r[1] or "").split())])})


def test_packing_stage(spark, docs):
    rows = plain(corpus_pipeline.pack_sequences(spark, docs, TINY).select(*(n.split()[0] for n in packing.PIECES.split(", "))))
    assert rows == plain(packing.pieces(docs).select(*(n.split()[0] for n in packing.PIECES.split(", "))))


def test_run_is_the_stages(spark, monkeypatch):
    """run() hands each stage what the one before kept."""
    step = lambda n: lambda spark, docs, sf_dir: docs.where(f"doc_id % {n} = 0")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("two", step(2)), ("three", step(3)), ("five", step(5))])
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, TINY).collect()) == list(range(0, 200, 30))


def test_clean_documents_stay(spark):
    docs = spark.createDataFrame([(i, f"A plain text number {i} about " + " ".join(f"thing{i}x{k}" for k in range(30)), "en", "web", 1) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, corpus_pipeline.drop_toxic(spark, docs, TINY), TINY)
    assert kept.count() == 40 and corpus_pipeline.redact_secrets(spark, kept, TINY).where(F.contains("text", F.lit("[SECRET]"))).count() == 0
