"""Tables by name, upserts, caches and the JSON forms of documents."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, where: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{where}/{name}.parquet")


#: Rows a task, where much is computed from each of them.
ROWS = 20_000


def spread(df: DataFrame, rows: int = ROWS) -> DataFrame:
    """df in partitions of some `rows` rows, as many as there are cores at least: much is computed from each row of a table that takes little room, so its bytes tell nothing of how long a task takes. Its rows are counted once."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // rows)))


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The newest row of each key of both, by `order` descending; applying the same rows twice changes nothing."""
    newest = Window.partitionBy(*key).orderBy(*order)
    return old.unionByName(new).withColumn("_nth", F.row_number().over(newest)).where("_nth = 1").drop("_nth")


def read_json(spark: SparkSession, glob: str, schema: StructType) -> DataFrame:
    """JSON documents or lines by a fixed schema, with the file each came from; what doesn't parse is null."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(glob).withColumn("path", F.input_file_name())


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A JSON lines log, or no rows if there is none yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); on one machine a temporary one where it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: what several steps read is made once, and a lost executor costs nothing."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one: what two runs write at once never meets."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def write_named(df: DataFrame, path: str, kind: str, key: str = "doc_id") -> None:
    """JSON documents (name, body), one a row, under <key>.<kind>.json. Many share a file: they're sorted by name over all files, so a file holds a range of names, and its statistics tell which."""
    name = F.concat(F.col(key).cast("string"), F.lit(f".{kind}.json"))
    made = df.select(name.alias("name"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("body"))
    made.repartitionByRange("name").sortWithinPartitions("name").write.mode("overwrite").option("parquet.block.size", 8 << 20).parquet(path)


def read_named(spark: SparkSession, path: str, glob: str, schema: StructType) -> DataFrame:
    """The documents whose names match a glob of * and ?, with their names. What stands before the first of these bounds the names, so files and their parts that hold no such name aren't read."""
    head = re.split(r"[*?]", glob)[0]
    pattern = "".join({"*": ".*", "?": "."}.get(c) or re.escape(c) for c in glob)
    named = spark.read.schema("name string, body string").parquet(path).where(F.col("name").startswith(head) & F.col("name").rlike(f"(?s)^{pattern}$"))
    return named.select(F.from_json("body", schema).alias("d"), "name").select("d.*", "name")


@dataclass(frozen=True)
class RuleStore:
    """Rule sets (section, version, rules) in a folder: each save adds a version of the sections it holds, and the highest of each counts."""

    spark: SparkSession
    path: str
    schema: str = "section string, version int, rules array<struct<id:string,text:string,triggers:array<string>,confidence:double>>"

    def load(self) -> DataFrame:
        every = read_or_empty(self.spark, self.path, StructType.fromDDL(self.schema))
        newest = Window.partitionBy("section").orderBy(F.desc("version"))
        return every.withColumn("_nth", F.row_number().over(newest)).where("_nth = 1").drop("_nth")

    def save(self, rules: DataFrame) -> None:
        rules.write.mode("append").json(self.path)

    def clear(self) -> None:
        self.spark.createDataFrame([], self.schema).write.mode("overwrite").json(self.path)


def cache_key(prompt: Column, temperature: float = 0.0, as_json: bool = False, space: str = "default") -> Column:
    """A digest of everything that decides a model's answer."""
    return F.sha2(F.to_json(F.struct(prompt.alias("prompt"), F.lit(temperature).alias("temperature"), F.lit(as_json).alias("json"), F.lit(space).alias("space"))), 256)


def with_cache(asked: DataFrame, cached: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """asked (key, ...) answered from cached (key, answer); only misses reach compute, which returns (key, answer)."""
    hits = asked.select("key").join(cached.select("key", "answer"), "key")
    misses = compute(asked.join(cached.select("key"), "key", "left_anti"))
    return hits.select("key", "answer", F.lit(True).alias("cached")).unionByName(misses.select("key", "answer", F.lit(False).alias("cached")))


def preferred(keys: DataFrame, first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """A value from the first table that has it, else the second; keys with neither go."""
    joined = keys.select(key).join(first.select(key, F.col(value).alias("_a")), key, "left").join(second.select(key, F.col(value).alias("_b")), key, "left")
    return joined.select(key, F.coalesce("_a", "_b").alias(value)).where(F.col(value).isNotNull())


def page_blocks(markdown: Column) -> Column:
    """A document's pages: pieces before each heading `Page N`, blank ones left out."""
    return F.filter(F.split(markdown, r"(?m)(?=^#{1,3} Page \d+)"), lambda p: F.btrim(p) != "")


def transcript_page(markdown: Column, page: Column) -> Column:
    """The block of one page of a transcript; the whole text where the page is missing."""
    found = F.filter(page_blocks(markdown), lambda p: F.regexp_extract(p, r"^#{1,3} Page (\d+)", 1) == page.cast("string"))
    return F.coalesce(F.regexp_replace(F.get(found, 0), r"^\s+|\s+$", ""), markdown)
