"""Intermediate tables in a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders of local applications that have no shared one.
_local_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a local session without one gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = "file://" + tempfile.mkdtemp(prefix="plumbline-")
    return _local_roots[app]


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table and read it back.

    Cuts the lineage of loops, survives lost executors and gives the planner
    real sizes. The folder goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/plumbline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _at(spark, path, lambda fs, p: fs.deleteOnExit(p))
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


class Rounds:
    """A table that a loop only adds to: each round's rows are a folder of their own, written once."""

    def __init__(self, spark: SparkSession, schema: str) -> None:
        self.spark, self.schema, self.n = spark, schema, 0
        self.path = f"{scratch_root(spark)}/plumbline-{uuid.uuid4().hex}"

    def add(self, rows: DataFrame) -> DataFrame:
        """Write the next round's rows, and give them back as read."""
        self.n += 1
        at = f"{self.path}/round={self.n}"
        rows.write.parquet(at)
        if self.n == 1:
            _at(self.spark, self.path, lambda fs, p: fs.deleteOnExit(p))
        return self.spark.read.schema(self.schema).parquet(at)

    def every(self, number: str | None = None) -> DataFrame:
        """The rows of all rounds; with ``number``, a column of that name has their round, from 1."""
        if not self.n:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(f"{self.schema}, round int").option("basePath", self.path).parquet(*[f"{self.path}/round={i}" for i in range(1, self.n + 1)])
        return rows.withColumnRenamed("round", number) if number else rows.drop("round")

    def discard(self) -> None:
        _at(self.spark, self.path, lambda fs, p: fs.delete(p, True))


def discard(df: DataFrame | None) -> None:
    """Remove a table of :func:`materialize` that nothing reads any more."""
    if df is not None:
        _at(df.sparkSession, df._scratch_path, lambda fs, p: fs.delete(p, True))


def _at(spark: SparkSession, path: str, act) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    act(p.getFileSystem(spark._jsc.hadoopConfiguration()), p)
