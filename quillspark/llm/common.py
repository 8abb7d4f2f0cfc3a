"""Table access, lineage cuts in the shared folder, and Arrow helpers used by every operator."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that their Python needs no path set."""
    context = spark.sparkContext
    if getattr(context, "_quillspark_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="package-")) / "quillspark.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    context.addPyFile(str(to))
    context._quillspark_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where both are one process (as in tests) a temporary one is set if it's unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='checkpoint-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def cut(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back, so that lost executors cost no recomputation.

    The job's shuffle files are removed as soon as the table stands; they'd otherwise wait for the driver's garbage collection.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{by or 'cut'}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def free(columns: list[str], name: str) -> str:
    """The name, with as many underscores after it as it takes to differ from all columns, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], dict | None], schema: str | StructType, rows: int = 2048) -> DataFrame:
    """mapInArrow with f on slices of at most so many rows; f returns columns by name in schema's order, or None for no rows."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                out = f(batch.slice(i, rows))
                if out is not None:
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) and x.type == t.type else pa.array(x, t.type) for x, t in zip(out.values(), arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    x = batch.column(column)
    return x.cast(pa.large_binary() if pa.types.is_large_string(x.type) else pa.binary()).to_pylist()
