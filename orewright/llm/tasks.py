"""Small helpers for Arrow batches in tasks."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_made: dict = {}
_served = ""


def once(key, make: Callable):
    """What ``make`` gives, made once in each Python worker; only the newest few are kept."""
    if key not in _made:
        while len(_made) >= 4:
            _made.pop(next(iter(_made)))
        _made[key] = make()
    return _made[key]


def serve(operator: str) -> None:
    """A worker turns to an operator: what it made for the one before goes, as workers live on from stage to stage."""
    global _served
    if operator != _served:
        _made.clear()
        _served = operator


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bound the rows and bytes of an Arrow batch, as texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 32 << 20)


def tasks_for(df: DataFrame, text: str, part_bytes: int = 64 << 20) -> int:
    """A number of tasks with about ``part_bytes`` of text each, and not less than ``spark.sql.shuffle.partitions``."""
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // part_bytes + 1)


def with_fields(schema: T.StructType, added: list[T.StructField]) -> T.StructType:
    """``schema`` and then ``added``; of equal names, in any case, the added ones stay."""
    names = {f.name.lower() for f in added}
    return T.StructType([f for f in schema.fields if f.name.lower() not in names] + added)


def arrow_map(df: DataFrame, f: Callable, added: list[T.StructField], keep: list[str] | None = None, reads: tuple[str, ...] = ()) -> DataFrame:
    """``mapInArrow`` of ``f(batch) -> iterable of (batch, {name: array})``: each result is the kept columns of its batch and the added ones."""
    kept = df.select(*keep).schema if keep is not None else df.schema
    schema = with_fields(kept, added)
    names = [x.name for x in schema.fields if x not in added]
    order = [x.name for x in schema.fields]
    operator = f.__module__

    def run(batches):
        serve(operator)
        for batch in batches:
            for part, columns in f(batch):
                yield pa.RecordBatch.from_arrays([columns[n] if n in columns else part.column(n) for n in order], names=order)
        pa.default_memory_pool().release_unused()  # workers serve other operators next

    read = list(dict.fromkeys([*names, *reads]))
    return (df.select(*[df[f"`{n}`"] for n in read]) if keep is not None else df).mapInArrow(run, schema)
