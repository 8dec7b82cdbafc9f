"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.scratch import discard, materialize  # noqa: F401  for the operators here

#: Runs of white space between words: space, tab, LF, VT, FF, CR.
WS = r"[\x20\x09-\x0D]+"


def whole_text(col: str = "text") -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(F.col(col), F.lit(""))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once a row and hand it to ``body`` as a variable.

    Inside lambda functions an inlined expression would run once an element;
    a bound variable never does.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_count(text: Column) -> Column:
    """Number of runs of non-white-space characters, as a long."""

    def count(parts: Column) -> Column:
        n = F.size(parts)
        lead = F.when(parts[0] == "", 1).otherwise(0)
        tail = F.when((n > 1) & (parts[n - 1] == ""), 1).otherwise(0)
        return (n - lead - tail).cast("long")

    return let(F.split(text, WS), count)


def text_key(text: Column) -> list[Column]:
    """Two 64-bit hashes that together identify a text."""
    return [F.xxhash64(text), F.xxhash64(F.lit("second"), text)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Let Arrow batches of whole documents have ``size`` bytes, unless the session says otherwise than Spark's default.

    The default of 64 MB is held several times over in each of the JVM and the
    Python workers.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "64m") in ("64m", "67108864b", "67108864"):
        spark.conf.set(key, size)


def release() -> None:
    """Give memory that a task has freed back to the system; the worker waits for other tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
