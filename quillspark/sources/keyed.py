"""A keyed table whose upserts rewrite only what they touch.

Rows lie by the bucket that their key hashes to, a folder a bucket and version. A manifest, of which every upsert adds a version, says which folder of each bucket counts, and up to which batch
each stream that feeds the table has come. An upsert merges its rows with those of their buckets, writes these buckets anew, and adds a manifest, which either stands as a whole or not at all: whoever reads meanwhile reads the version
before, a job that fails or runs twice changes nothing, and of two writers at once the second fails.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "folders map<string,string>, batches map<string,bigint>"


@dataclass(frozen=True)
class Manifest:
    """Of a table: version, the folder of each bucket that has rows, the last batch of each stream."""

    version: int
    folders: dict[int, str]
    batches: dict[str, int]


@dataclass(frozen=True)
class KeyedTable:
    """The newest row of each key, by `order` descending; rows that tie are told apart by all their columns, so results don't depend on the order of batches."""

    spark: SparkSession
    path: str
    schema: str
    key: tuple[str, ...]
    order: tuple[str, ...]
    buckets: int = 64

    def manifest(self) -> Manifest:
        """The latest version; 0 of a table without rows."""
        try:
            every = self.spark.read.schema(f"{MANIFEST}, version int").json(f"{self.path}/manifest")
            last = every.orderBy(F.desc("version")).first()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            last = None
        return Manifest(0, {}, {}) if last is None else Manifest(last["version"], {int(b): f for b, f in (last["folders"] or {}).items()}, last["batches"] or {})

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _rows(self, folders: list[str]) -> DataFrame:
        schema = StructType.fromDDL(self.schema)
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in sorted(folders)))

    def read(self) -> DataFrame:
        return self._rows(list(self.manifest().folders.values()))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of the given keys, out of their buckets only."""
        folders = self.manifest().folders
        wanted = {r["b"] for r in keys.select(self._bucket().alias("b")).distinct().collect()}  # at most as many as there are buckets
        return self._rows([f for b, f in folders.items() if b in wanted]).join(keys.select(*self.key).distinct(), list(self.key), "left_semi")

    def upsert(self, rows: DataFrame, stream: str | None = None, batch: int | None = None) -> bool:
        """Merges rows in; False, and nothing done, if the stream's batch is in the table already."""
        before = self.manifest()
        if stream is not None and batch is not None and batch <= before.batches.get(stream, -1):
            return False
        columns = StructType.fromDDL(self.schema).names
        new = rows.select(*columns)
        touched = {r["b"] for r in new.select(self._bucket().alias("b")).distinct().collect()}  # at most as many as there are buckets
        old = self._rows([f for b, f in before.folders.items() if b in touched])
        newest = Window.partitionBy(*self.key).orderBy(*(F.desc(c) for c in self.order), *(F.desc(c) for c in columns if c not in self.order))
        merged = old.unionByName(new).withColumn("_nth", F.row_number().over(newest)).where("_nth = 1").drop("_nth").withColumn("_bucket", self._bucket())
        folder = f"rows-{uuid.uuid4().hex}"
        if touched:
            merged.repartition(max(1, len(touched)), "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        folders = before.folders | {b: f"{folder}/_bucket={b}" for b in touched}
        batches = before.batches | ({stream: batch} if stream is not None and batch is not None else {})
        one = self.spark.createDataFrame([({str(b): f for b, f in folders.items()}, batches)], MANIFEST).coalesce(1)
        one.write.mode("errorifexists").json(f"{self.path}/manifest/version={before.version + 1}")
        return True
