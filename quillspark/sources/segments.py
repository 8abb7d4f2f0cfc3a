"""A search index over edits in segments: appended, never rewritten, and merged when there are many.

Each append is a segment: the vectors of its edits, laid out by section, so that a search reads the sections asked for only. Deletions are segments of tombstones; of an edit that is in
several segments the newest counts, whether it's there or gone. A search takes the nearest of each segment, and merges these: as many as asked for and as could be outdated.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import index, learn, retrieve

EDITS = "edit_id string, matter_id string, field_path string, edit_type string, before string, after string"
#: Edits that a task writes.
EDITS_A_TASK = 100_000
_VECTOR = "vector array<struct<bucket:bigint,weight:double>>"


@dataclass(frozen=True)
class EditIndex:
    spark: SparkSession
    path: str

    def _all(self) -> DataFrame:
        """edit_id, gone, payload, vector, segment, section of every segment."""
        schema = f"{EDITS}, gone boolean, {_VECTOR}, segment int, section string"
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/segments")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def last(self) -> int:
        """The number of the newest segment, 0 without any; by the folders, no row is read."""
        return self._all().agg(F.max("segment").alias("n")).first()["n"] or 0

    def _write(self, rows: DataFrame, segment: int, text: Column | None = None) -> None:
        """Rows are dealt out by edit, some EDITS_A_TASK a task, so that a section of many is no task's alone; each writes a file for each section it has."""
        tasks = max(1, -(-rows.count() // EDITS_A_TASK))
        rows = rows.repartition(tasks if tasks == 1 else max(tasks, self.spark.sparkContext.defaultParallelism), "edit_id")
        rows = rows if text is None else index.with_dense_vectors(rows, text)
        rows.select(*(c.split()[0] for c in EDITS.split(", ")), "gone", "vector", F.lit(segment).alias("segment"), "section").write.partitionBy("segment", "section").mode("append").parquet(f"{self.path}/segments")

    def append(self, edits: DataFrame) -> int:
        """Adds edits (edit_id, matter_id, section, field_path, edit_type, before, after) as a segment, and returns its number. Edits that come again replace what they were."""
        segment = self.last() + 1
        self._write(edits.withColumn("gone", F.lit(False)), segment, learn.summary(edits))
        return segment

    def delete(self, edits: DataFrame) -> int:
        """Marks edits (edit_id, section) as gone."""
        segment, none = self.last() + 1, F.lit(None).cast("string")
        fields = [none.alias(c.split()[0]) for c in EDITS.split(", ")[1:]]
        self._write(edits.select("edit_id", *fields, F.lit(True).alias("gone"), F.array().cast(_VECTOR.split(" ", 1)[1]).alias("vector"), "section"), segment)
        return segment

    def current(self, sections: list[str] | None = None) -> DataFrame:
        """The edits that are there, as their newest segment has them."""
        every = self._all() if sections is None else self._all().where(F.col("section").isin(sections))
        newest = Window.partitionBy("section", "edit_id").orderBy(F.desc("segment"))
        return every.withColumn("_nth", F.row_number().over(newest)).where("_nth = 1 and not gone").drop("_nth")

    def compact(self, path: str) -> EditIndex:
        """The same edits as one segment of a new index."""
        out = EditIndex(self.spark, path)
        out._write(self.current(), 1)
        return out

    def search(self, queries: DataFrame, k: int = 3, matter: str | None = None) -> DataFrame:
        """query_id, edit_id, matter_id, field_path, score, rank: the k edits of a query's section (query_id, section, text) closest by hashed vectors, of one matter only if it's given.

        An edit of an older segment that a newer one replaces or deletes is outdated: those are left out by their ids before scores are ranked, so what is found equals a search of an index made anew. Few rows
        a section, as deletions and repeated edits are; segments without any take no join.
        """
        asked = index.dense_vectors(queries.select(F.col("section").alias("corpus_key"), F.col("query_id").alias("chunk_id"), "text")).groupBy("corpus_key", "chunk_id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("asked"))
        asked = asked.select(F.col("corpus_key").alias("section"), F.col("chunk_id").alias("query_id"), "asked")
        sections = [r["section"] for r in queries.select("section").distinct().collect()]  # as many as the product has sections
        every = self._all().where(F.col("section").isin(sections))
        last = every.groupBy("section", "edit_id").agg(F.max("segment").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
        held = every.where("not gone")
        if matter is not None:
            held = held.where(F.col("matter_id") == matter)
        held = held.join(last, ["section", "edit_id"], "left").where("last is null or last = segment")
        score = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x["weight"] * F.coalesce(F.try_element_at(F.col("asked"), x["bucket"]), F.lit(0.0)))
        near = held.join(asked, "section").where(F.arrays_overlap(F.transform("vector", lambda x: x["bucket"]), F.map_keys("asked")))
        scored = near.select("query_id", "edit_id", "matter_id", "field_path", "segment", score.alias("score"))
        per = retrieve.top(scored, k, 6, ("query_id", "segment"), "edit_id")
        return retrieve.top(per.drop("rank"), k, 6, ("query_id",), "edit_id").drop("segment")


def rebuilt(spark: SparkSession, path: str, appends: list[DataFrame]) -> EditIndex:
    """An index of all the edits in one segment: what a search of the segments is held to."""
    out = EditIndex(spark, path)
    out.append(reduce(DataFrame.unionByName, appends))
    return out
