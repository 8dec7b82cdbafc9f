"""Line dedup by the number of sites a line spreads over.

A HyperLogLog sketch of sites for each line hash merges by aggregation; lines
whose estimate is near the threshold get an exact distinct count. Of a line on
enough sites one occurrence stays, the first by document id; the others go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import materialize, text_key, whole_text

#: Sketches have 2**LG_K registers when full; their relative error is about ERROR.
LG_K, ERROR = 12, 1.04 / 64
#: Characters trimmed from the ends of a line before it is compared.
TRIMMED = " \t\x0b\x0c\r"


def spread_lines(lines: DataFrame, min_sites: int, margin: float = 4 * ERROR) -> DataFrame:
    """(h1, h2, first): lines (h1, h2, site, at) that ``min_sites`` or more distinct sites have.

    ``first`` is the least ``at``. Estimates within ``margin`` of the threshold are
    replaced by exact counts.
    """
    sketched = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.min("at").alias("first"))
    low = min_sites * (1 - margin) - 0.5
    high = min_sites * (1 + margin) + 0.5
    candidates = sketched.select("h1", "h2", "first", F.hll_sketch_estimate("sketch").alias("estimate")).where(F.col("estimate") >= low)
    candidates = materialize(candidates)
    sure = candidates.where(F.col("estimate") > high).select("h1", "h2", "first")
    near = candidates.where(F.col("estimate") <= high).select("h1", "h2", "first")
    # Dealt by line and site before they are made distinct: the join's own dealing, by line, would leave a line's rows to one task.
    sited = lines.join(near, ["h1", "h2"]).repartition("h1", "h2", "site").groupBy("h1", "h2", "first", "site").agg(F.lit(1).alias("one"))
    exact = sited.groupBy("h1", "h2", "first").agg(F.count("*").alias("n"))
    return sure.unionByName(exact.where(F.col("n") >= min_sites).select("h1", "h2", "first"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def dedup_lines(docs: DataFrame, site: str = "source", text: str = "text", doc_id: str = "doc_id", min_sites: int = 6) -> DataFrame:
    """``docs`` with cross-site lines taken out of ``text``, and ``n_lines`` and ``n_removed``.

    Lines are compared whole, without white space at their ends; lines without
    a word never count. A line of ``min_sites`` or more sites stays in its first
    occurrence, by document id (null last), then a hash of the text, then place.
    A null site is a site; equal rows are changed alike; null and empty texts
    stay as they are. Texts and lines of any length are taken whole. An empty
    table gives no rows. Columns called n_lines or n_removed are replaced; other
    names don't matter.
    """
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    # The row is one column beside those made here, so that no name of it can clash.
    rows = docs.select(F.struct(*keep).alias("row"), *[k.alias(n) for k, n in zip(text_key(whole_text(text)), ("k1", "k2"), strict=True)])
    body = F.col("row")[text]
    own = F.col("row")[doc_id]
    lines = rows.select(
        F.coalesce(F.concat(F.lit("="), F.col("row")[site].cast("string")), F.lit("")).alias("site"),
        own.alias("id"), "k1", "k2", F.posexplode(_lines(F.coalesce(body, F.lit("")))).alias("line_no", "line"),
    ).withColumn("line", F.btrim("line", F.lit(TRIMMED))).where("line <> ''")
    at = F.struct(F.col("id").isNull().alias("last"), "id", "k1", "k2", "line_no").alias("at")
    lines = materialize(lines.select("site", at, F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), "line").alias("h2")))
    wide = materialize(spread_lines(lines, min_sites))
    extra = lines.join(wide, ["h1", "h2"]).where(F.col("at") != F.col("first"))
    gone = materialize(extra.groupBy("at.id", "at.k1", "at.k2").agg(F.collect_set("at.line_no").alias("gone")))
    same = own.eqNullSafe(F.col("g.id")) & (F.col("r.k1") == F.col("g.k1")) & (F.col("r.k2") == F.col("g.k2"))
    joined = rows.alias("r").join(gone.alias("g"), same, "left")
    left = F.array_join(F.filter(_lines(body), lambda x, i: ~F.array_contains("gone", i)), "\n")
    return joined.select(
        *[F.when(F.col("gone").isNull(), body).otherwise(left).alias(text) if c == text else F.col("row")[c].alias(c) for c in keep],
        F.when(F.coalesce(body, F.lit("")) == "", 0).otherwise(F.size(_lines(body))).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )
