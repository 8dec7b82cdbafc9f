"""Five 75th percentiles for each project, and the scores made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import round_half_up, sub_score
from plumbline.functions.stats import percentile
from plumbline.operators import graph
from plumbline.schemas import METRICS


def compute_metrics(nodes: DataFrame, structure: DataFrame) -> DataFrame:
    """A row a project with one column a metric.

    Sizes and complexities of 0 don't count; coupling and depth are over all
    nodes; cycles are the sizes of components with more than one node.
    """
    per_node = nodes.groupBy("project").agg(
        percentile(F.when(F.col("loc") > 0, F.col("loc")), 75).alias("locPerModule"),
        percentile(F.when(F.col("complexity") > 0, F.col("complexity")), 75).alias("complexity"),
        percentile((F.col("fan_in") + F.col("fan_out")).cast("double"), 75).alias("fanInOut"),
    )
    depth = structure.groupBy("project").agg(percentile("depth", 75).alias("depDepth"))
    cycles = graph.cycle_sizes(structure).groupBy("project").agg(percentile("size", 75).alias("circularDeps"))
    wide = per_node.join(depth, "project", "left").join(cycles, "project", "left")
    return wide.select("project", *[F.coalesce(m, F.lit(0.0)).alias(m) for m in METRICS])


def metric_scores(metrics: DataFrame, config: DataFrame) -> DataFrame:
    """Long rows (project, metric_ord, metric, raw_p75, sub_score, weight) for the projects of ``config``; a project without nodes has zeros."""
    long = metrics.unpivot("project", list(METRICS), "metric", "raw")
    return config.join(long, ["project", "metric"], "left").select(
        "project", "proj_ord", "metric_ord", "metric",
        F.coalesce("raw", F.lit(0.0)).alias("raw_p75"),
        sub_score(F.coalesce("raw", F.lit(0.0)), "good", "bad", "direction").alias("sub_score"),
        "weight",
    )


def project_scores(scores: DataFrame) -> DataFrame:
    """Weighted mean a project, two decimals; null where the weights add to 0."""
    # Added up in metric order, so that the sum doesn't depend on the shuffle.
    ordered = F.sort_array(F.collect_list(F.struct("metric_ord", "metric", "raw_p75", "sub_score", "weight")))
    rows = scores.groupBy("project", "proj_ord").agg(ordered.alias("breakdown"))
    total = lambda f: F.aggregate("breakdown", F.lit(0.0), lambda a, x: a + f(x))
    mean = F.try_divide(total(lambda x: x["weight"] * x["sub_score"]), total(lambda x: x["weight"]))
    return rows.select("project", "proj_ord", round_half_up(mean).alias("score"), "breakdown")


def headline(scores: DataFrame) -> DataFrame:
    """The mean over projects, two decimals."""
    return scores.agg(round_half_up(F.avg("score")).alias("score"))
