"""Tables and files kept between the jobs of one operator, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_LOCAL = ("", "file")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset: a temporary folder in local mode, and on a cluster a folder in the warehouse if that isn't a machine's own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
            _own[app] = "file://" + tempfile.mkdtemp(prefix="orewright-")
        else:
            warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
            if warehouse.partition(":")[0] in _LOCAL or ":" not in warehouse:
                raise RuntimeError("executors share no folder: set spark.checkpoint.dir to one that all of them reach")
            _own[app] = warehouse + "/_orewright"
    return _own[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/orewright/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later jobs neither recompute it nor depend on one executor."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, path: str) -> None:
    """Remove a path that :func:`fresh_path` gave."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables of one operator under one path of the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.kept = spark, fresh_path(spark, name), {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Like :func:`materialize`; a table kept under the same name before the last one is removed."""
        old = self.kept.setdefault(name, [])
        old.append(f"{self.path}/{name}-{uuid.uuid4().hex}")
        df.write.parquet(old[-1])
        if len(old) > 2:
            release(self.spark, old.pop(0))
        return self.spark.read.schema(df.schema).parquet(old[-1])

    def drop(self, name: str) -> None:
        """Remove all tables kept under a name."""
        for path in self.kept.pop(name, []):
            release(self.spark, path)


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[Scratch]:
    """A :class:`Scratch` whose tables are removed at the end, so what is returned must be written before that."""
    own = Scratch(spark, name)
    try:
        yield own
    finally:
        release(spark, own.path)
