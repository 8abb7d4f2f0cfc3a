"""The registered queries run over whole tables, against their SQL where there is one; and the pipeline, stage by stage."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import same

import __spark_entry__ as entry
import corpus_pipeline
from quillspark.llm import queries

TINY = "/root/testdata/sf0.001"
ROWS = {"op8_learned_partitions": 500, "op9_html_main_text": 50, "op5_packing": None, "op11_embedding_whitening": 2000}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, TINY)
    if name in queries.ORACLE_SQL:
        same(df, queries.ORACLE_SQL[name], TINY)
    elif (n := ROWS.get(name, 200)) is not None:
        assert df.count() == n
    else:
        assert df.count() > 0


def test_registered():
    assert "pipeline" in entry.queries() and set(queries.QUERIES) <= set(entry.queries())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    before, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, TINY), name)
        assert docs.columns == before
        kept[name] = docs.count()
    assert 0 < kept["simhash_near_dedup"] < kept["toxicity"] <= 200
    assert kept["secret_scan"] == kept["simhash_near_dedup"]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, TINY)
    assert packed.agg({"length": "sum"}).first()[0] > 0 and packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_pipeline_on_an_empty_table(spark, tmp_path):
    where = str(tmp_path)
    for t in ("documents", "labels"):
        spark.read.parquet(f"{TINY}/{t}.parquet").limit(0).write.parquet(f"{where}/{t}.parquet")
    assert corpus_pipeline.run(spark, where).count() == 0
