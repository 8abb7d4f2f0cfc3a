"""Log lines as JSON with a trace id that spans a run, the time that steps take, and measures of the tables that queries run over."""

from __future__ import annotations

import contextvars
import json
import logging
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NumericType

_trace: contextvars.ContextVar[str | None] = contextvars.ContextVar("trace", default=None)


def bind(trace_id: str | None = None) -> str:
    """The trace id of what follows in this context, a new one by default."""
    value = trace_id or uuid.uuid4().hex[:16]
    _trace.set(value)
    return value


def trace_id() -> str | None:
    return _trace.get()


class Lines(logging.Formatter):
    """Each record as one JSON object; what a call passes as extra fields={...} is part of it."""

    def format(self, record: logging.LogRecord) -> str:
        return json.dumps({"event": record.getMessage(), "level": record.levelname.lower(), "logger": record.name, "trace_id": trace_id(), **getattr(record, "fields", {})}, default=str)


def logger(name: str, level: int = logging.INFO) -> logging.Logger:
    out = logging.getLogger(name)
    if not any(isinstance(h.formatter, Lines) for h in out.handlers):
        handler = logging.StreamHandler()
        handler.setFormatter(Lines())
        out.addHandler(handler)
        out.setLevel(level)
    return out


@contextmanager
def step(name: str, log: logging.Logger, **fields: object) -> Iterator[None]:
    """Logs how long a step took, and whether it failed."""
    began, failed = time.monotonic(), True
    try:
        yield
        failed = False
    finally:
        log.info(name, extra={"fields": fields | {"seconds": round(time.monotonic() - began, 3), "failed": failed}})


class Measures:
    """What is measured of tables while a query runs over them: rows, nulls of each column and sums of numeric ones, by step, under one trace id.

    Nothing is scanned for it: the numbers come with the jobs that read the tables anyway, and stand after the first of these.
    """

    def __init__(self, trace: str | None = None):
        self.trace = trace or trace_id() or bind()
        self._steps: list[tuple[str, Observation, list[tuple[str, str]]]] = []

    def of(self, df: DataFrame, name: str) -> DataFrame:
        """df, measured as a step of that name."""
        seen = Observation(f"{self.trace}/{len(self._steps)}/{name}")
        what = [("rows", "", F.count(F.lit(1)))]
        for i, f in enumerate(df.schema):
            c = F.col(f"`{f.name}`")
            what.append(("nulls", f.name, F.count_if(c.isNull())))
            if isinstance(f.dataType, NumericType):
                what.append(("sum", f.name, F.sum(c.cast("double") if not isinstance(f.dataType, IntegralType) else c)))
        self._steps.append((name, seen, [(m, column) for m, column, _ in what]))
        return df.observe(seen, *(value.alias(f"m{i}") for i, (_, _, value) in enumerate(what)))

    def table(self, spark: SparkSession) -> DataFrame:
        """trace_id, step, measure, column, value of all steps; waits for those whose job hasn't run yet."""
        rows = [(self.trace, name, measure, column, None if (v := seen.get[f"m{i}"]) is None else float(v)) for name, seen, what in self._steps for i, (measure, column) in enumerate(what)]
        return spark.createDataFrame(rows, "trace_id string, step string, measure string, column string, value double")
