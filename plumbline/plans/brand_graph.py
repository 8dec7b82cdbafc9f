"""A dependency graph in the test tables: brands are projects, parts modules.

Consecutive lines of an order whose parts have one brand make an edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.schemas import DEFAULT_BASELINES, LOWER, METRICS
from plumbline.sources.tool_json import ToolOutput


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with their repetitions. An order can hold a line number more than once; each pair of consecutive lines counts."""
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    # Brands come before the self-join, so that it pairs within a brand and needs no join after it.
    lines = _table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "l_partkey", F.col("p_brand").alias("project"))
    after = lines.select("l_orderkey", "project", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("next"))
    pairs = lines.join(after, ["l_orderkey", "l_linenumber", "project"])
    return pairs.select("project", F.col("l_partkey").cast("string").alias("src"), F.col("next").cast("string").alias("dst"))


def brand_output(spark: SparkSession, sf_dir: str) -> ToolOutput:
    """The three frames of all brands; sizes from the ordered quantities and the part's size."""
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    sold = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").alias("q"))
    stats = part.join(sold, "p_partkey", "left").select(
        F.col("p_brand").alias("project"), F.col("p_partkey").cast("string").alias("path"),
        F.floor(F.coalesce("q", F.lit(0.0)) / 10).cast("double").alias("loc"), F.floor(F.col("p_size") / 3).cast("double").alias("complexity"), F.lit(0).cast("long").alias("ord"),
    )
    modules = part.select(F.col("p_brand").alias("project"), F.col("p_partkey").cast("string").alias("source"))
    return ToolOutput(stats, modules, raw_edges(spark, sf_dir))


def brand_config(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(project_config, metric_config): shared defaults with overrides for some brands.

    Every second brand has narrower depth and coupling baselines, every fifth
    weighs coupling 3, every third has a threshold of -1, every seventh seeds.
    """
    spec = spark.createDataFrame([(i, m, float(b["good"]), float(b["bad"]), b["direction"]) for i, m in enumerate(METRICS) for b in [DEFAULT_BASELINES[m]]], "metric_ord int, metric string, good double, bad double, direction string")
    brands = _table(spark, sf_dir, "part").select(F.col("p_brand").alias("project")).distinct()
    # One row a brand meets in this window.
    brands = brands.withColumn("proj_ord", (F.row_number().over(Window.orderBy("project")) - 1).cast("int"))
    project = brands.select(
        "project", "proj_ord", F.concat(F.lit("./"), F.col("project")).alias("src_dir"),
        F.when(F.col("proj_ord") % 7 == 0, 0.0).otherwise(6.0 + F.col("proj_ord") % 4).alias("last_score"),
        F.coalesce(F.when(F.col("proj_ord") % 3 == 0, -1.0), F.lit(-2.0)).alias("threshold"),
    )
    override = spark.createDataFrame([("depDepth", 1.0, 6.0, LOWER), ("fanInOut", 0.0, 4.0, LOWER)], "metric string, o_good double, o_bad double, o_direction string")
    overrides = brands.where("proj_ord % 2 = 0").join(F.broadcast(override)).select("project", "metric", "o_good", "o_bad", "o_direction")  # two rows
    every = brands.select("project", "proj_ord", F.explode(F.array(*map(F.lit, METRICS))).alias("metric")).join(spec, "metric")
    joined = every.join(overrides, ["project", "metric"], "left")
    weight = F.when((F.col("metric") == "fanInOut") & (F.col("proj_ord") % 5 == 0), 3.0)
    metric = joined.select(
        "project", "proj_ord", "metric_ord", "metric",
        F.coalesce("o_good", "good").alias("good"), F.coalesce("o_bad", "bad").alias("bad"), F.coalesce("o_direction", "direction").alias("direction"),
        F.coalesce(weight, F.lit(1.0)).alias("weight"),
    )
    return project, metric
