"""Queries do their whole job: texts longer than any bound that once stood."""

import os

import duckdb
import pytest
from compare import TABLES, same
from pyspark.sql import functions as F

from conftest import TINY
from quillspark.operators import chunk, extract, quality
from quillspark.plans import registry


@pytest.fixture
def with_documents(tmp_path):
    """A folder of the small tables whose documents are made by SQL out of theirs."""

    def made(sql: str) -> str:
        for t in set(TABLES) - {"documents"}:
            os.symlink(f"{TINY}/{t}.parquet", tmp_path / f"{t}.parquet")
        duckdb.connect().execute(f"COPY ({sql.format(documents=f"'{TINY}/documents.parquet'")}) TO '{tmp_path}/documents.parquet'")
        return str(tmp_path)

    return made


def test_windows_of_long_texts_have_their_context(spark, with_documents):
    """Over 400 windows: the later ones were left out, and vesting chunks took their numbers."""
    where = with_documents("SELECT * REPLACE (CASE WHEN doc_id = 3 THEN repeat('one two Page 7 three ', 8000) ELSE text END AS text) FROM {documents} WHERE doc_id < 9")
    out = registry.QUERIES["contextual_chunks"](spark, where)
    assert out.where("doc_id = 3").count() == 502
    same(out, registry.SQL["contextual_chunks"], where)


def test_windows_are_told_apart(spark):
    """Numbers of five digits were cut to four."""
    docs = spark.createDataFrame([(1, "deed", "same " * 10_020)], "doc_id long, doc_type string, text string")
    assert chunk.contextual_chunks(docs, spark.createDataFrame([], "doc_id long, ordinal int, name string, role string"), 1, 0).select("chunk_id").distinct().count() == 10_020


def test_long_documents_are_taken_in_whole(spark, with_documents):
    """Over 500 pages, some read twice, some by the second parser alone, some by hand: the later ones were left out."""
    long = "substr(repeat('Some words of page after page. ', 6000), 1, CASE doc_id WHEN 4 THEN 180004 ELSE 180000 END)"
    where = with_documents("SELECT * REPLACE (CASE WHEN doc_id IN (3, 4, 5) THEN " + long + " ELSE text END AS text) FROM {documents} WHERE doc_id < 12")
    out = registry.QUERIES["document_intake"](spark, where)
    assert {r["n_pages"] for r in out.where("doc_id IN (3, 4, 5)").collect()} == {600, 601}
    same(out, registry.SQL["document_intake"], where)


def test_pages_of_two_lists_meet(spark):
    """By number, the first of pages that share one, whatever is missing on either side."""
    df = spark.createDataFrame([([(p,) for p in (1, 2, 2, 4, 9)], [(0, "z"), (2, "a"), (2, "b"), (3, "c"), (9, "d")])], "own array<struct<page:int>>, others array<struct<page:int,t:string>>")
    assert df.select(F.transform(quality._beside(F.col("own"), F.col("others")), lambda q: q["t"])).first()[0] == [None, "a", "a", None, "d"]


def test_documents_have_all_their_facts(spark):
    """More parties, links, liens, easements, restrictions and items than lists once held; the queries of single kinds keep their caps, as their SQL does."""
    gap = lambda i: f"Nothing stands in part {i}. " * 15
    names = [f"{a}{b} Roe" for a in ("Ab", "Bo", "Cy", "Di", "Ed") for b in ("da", "el", "ir", "on", "us", "va", "wy")]
    told = [f"a Mortgage in Book {i}, Page 7; " for i in range(40)] + [f"a Utility easement of lot {i}; " for i in range(25)] + [f"deed restrictions of lot {i}; " for i in range(18)]
    body = "Deed" + "".join(f" to {n}, one;" for n in names) + "".join(gap(i) + x for i, x in enumerate(told)) + gap(99)
    items = "".join(f"{k}. Provide a paper of lot number {k}.\n" for k in (*range(1, 27), *"abc"))
    body += f"\nI. Requirements\n{items}II. Exceptions\n{items}Schedule C of it"
    docs = spark.createDataFrame([(1, "survey", body)], "doc_id long, doc_type string, text string")
    out = extract.title_documents(docs).select(*(F.size(c).alias(c) for c in ("parties", "chain_of_title", "open_liens", "easements", "restrictions", "schedule_b_requirements", "schedule_b_exceptions"))).first()
    assert out.asDict() == {"parties": 35, "chain_of_title": 40, "open_liens": 40, "easements": 25, "restrictions": 18, "schedule_b_requirements": 29, "schedule_b_exceptions": 29}
    short = extract.composable(docs).select(F.size("instruments"), F.size("easements")).first()
    assert tuple(short) == (40, 25)
    assert docs.select(F.size(extract.parties(F.col("text"))), F.size(extract.easements(F.col("text")))).first()[:] == (12, 20)
