"""Mixing sources to target weights with a low-discrepancy schedule.

The points of a golden-ratio sequence, mapped through the cumulated targets,
name the source of each slot. The slots of a source are ranked, and the slot of
rank r takes block r of the source's shuffled stream, cut into blocks of equal
token counts. Ranks and stream positions are prefix sums of two levels, so no
source, however large, is handled by one task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import materialize, whole_text, word_count

#: 2**32 / golden ratio, an odd number: i * STEP mod 2**32 visits each point once.
STEP, POINTS = 2654435769, 1 << 32
#: Slots of a rank chunk, and cells into which the points are cut for the join with the sources.
CHUNK_BITS, CELL_BITS = 12, 12
#: Buckets by leading bits of the 52-bit shuffle key.
BUCKET_SHIFT = 40


@dataclass
class Mix:
    """``targets``: a row a source. ``schedule``: a row a slot. ``takes``: a row a document."""

    targets: DataFrame
    schedule: DataFrame
    takes: DataFrame
    block: int


def shuffle_key(doc_id: Column, text: Column, seed: str) -> Column:
    """52 bits that order documents at random, alike in every run; documents without an id go by their texts."""
    named = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), F.md5(text)))
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), named)), 1, 13), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, repeats: int = 2) -> DataFrame:
    """Target tokens of each row of ``sizes`` (source, source_size).

    Sources by code point, null last, weigh ``weights``, repeating. Together
    they get ``share`` of all sizes; none gets over ``repeats`` times its own,
    and the excess goes to the others by weight until none is above.
    """
    # One row a source meets in the window; documents never do.
    ranked = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1))
    every = Window.partitionBy()
    by_ratio = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    level = (
        ranked.withColumn("_cap", F.col("source_size") * repeats)
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .withColumn("_k", F.row_number().over(by_ratio))
        .withColumn("_before_cap", F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("_before_w", F.sum("_w").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("_level", (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce("_before_cap", F.lit(0))) / (F.sum("_w").over(every) - F.coalesce("_before_w", F.lit(0))))
    )
    first = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_k", "_level"))).over(every)["_level"]
    # share > repeats would leave no such level; then every source is at its cap.
    return level.withColumn("_final", first).select(
        "source", "source_size", F.when(F.col("_ratio") < F.col("_final"), F.col("_cap")).otherwise(F.coalesce(F.col("_final") * F.col("_w"), F.col("_cap"))).cast("double").alias("target")
    )


def source_schedule(spark: SparkSession, targets: DataFrame, n_slots: int) -> DataFrame:
    """Slots 0 to n_slots - 1 with their source and their rank among its slots."""
    width = POINTS >> CELL_BITS
    up_to = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("target").over(Window.partitionBy())
    bounds = (
        targets.withColumn("_hi", F.floor(F.sum("target").over(up_to) / total * POINTS))
        .withColumn("_last", F.row_number().over(Window.orderBy(F.col("source").desc_nulls_first())) == 1)
        .withColumn("_hi", F.when(F.col("_last"), F.lit(POINTS)).otherwise(F.least("_hi", F.lit(POINTS))))
        .withColumn("_lo", F.coalesce(F.lag("_hi").over(Window.orderBy(F.col("source").asc_nulls_last())), F.lit(0)))
        .where("_lo < _hi")
        .select("source", "_lo", "_hi", F.explode(F.sequence(F.floor(F.col("_lo") / width), F.floor((F.col("_hi") - 1) / width))).alias("_cell"))
    )
    points = spark.range(n_slots).select(F.col("id").alias("slot"), (F.col("id") * STEP % POINTS).alias("_p")).withColumn("_cell", F.floor(F.col("_p") / width))
    slots = points.join(bounds, "_cell").where("_lo <= _p and _p < _hi").select("slot", "source", F.shiftright("slot", CHUNK_BITS).alias("_chunk"))
    slots = materialize(slots)
    before = slots.groupBy("source", "_chunk").agg(F.count("*").alias("_n"))
    before = before.select("source", "_chunk", (F.sum("_n").over(Window.partitionBy("source").orderBy("_chunk")) - F.col("_n")).alias("_before"))
    within = slots.withColumn("_rn", F.row_number().over(Window.partitionBy("source", "_chunk").orderBy("slot")))
    return within.alias("s").join(before.alias("b"), F.col("s.source").eqNullSafe(F.col("b.source")) & (F.col("s._chunk") == F.col("b._chunk"))).select(
        "slot", "s.source", (F.col("_before") + F.col("_rn") - 1).alias("rank")
    )


def filled_schedule(schedule: DataFrame, targets: DataFrame, n_slots: int, block: int) -> DataFrame:
    """``schedule`` and, after its ``n_slots`` slots, those that a source lacks for all blocks of its target."""
    have = schedule.groupBy("source").agg(F.count("*").alias("_have"))
    lacking = targets.alias("t").join(have.alias("h"), F.col("t.source").eqNullSafe(F.col("h.source")), "left").select("t.source", F.coalesce("_have", F.lit(0)).alias("_have"), F.ceil(F.ceil("target") / block).alias("_need")).where("_need > _have")
    # One row a source meets in the window, as in the targets.
    up_to = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    first = n_slots + F.coalesce(F.sum(F.col("_need") - F.col("_have")).over(up_to), F.lit(0))
    more = lacking.withColumn("_first", first).withColumn("rank", F.explode(F.sequence("_have", F.col("_need") - 1)))
    return schedule.unionByName(more.select((F.col("_first") + F.col("rank") - F.col("_have")).alias("slot"), "source", "rank"))


def mix_sources(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    repeats: int = 2,
    slots: int = 1 << 16,
    slots_a_source: int = 1 << 12,
    seed: str = "mix",
) -> Mix:
    """Mix whole ``docs`` to the targets of :func:`source_targets`.

    ``takes`` has doc_id, source, text_key (of the text, for joining back),
    size, source_size, target and taken: words that the mix takes of the
    document, repeats counted. Each source reaches its target, rounded up,
    however small it is beside the others: slots that the sequence lacks for it
    follow at the end. A null text has size 0, a null source is a source, null
    ids are shuffled by their texts, and equal rows each get a row of their own.
    Documents of size 0 are never taken; one of any length is cut at the ends of
    blocks and counts whole. An empty table gives empty results. Other columns
    of ``docs`` are ignored, whatever their names.
    """
    spark = docs.sparkSession
    t = whole_text(text)
    sized = materialize(
        docs.select(
            F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.xxhash64(t).alias("text_key"),
            word_count(t).alias("size"), shuffle_key(F.col(doc_id), t, seed).alias("_key"),
        )
    )
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(source_targets(sizes, weights, share, repeats))
    words, n_sources = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.count("*")).first()
    # Of whole numbers, so that it is the same whatever the order of addition.
    total = math.ceil(min(share, repeats) * words)
    block = max(1, -(-total // max(slots, slots_a_source * n_sources)))
    n_slots = -(-total // block)
    schedule = materialize(source_schedule(spark, targets, n_slots))
    schedule = materialize(filled_schedule(schedule, targets, n_slots, block))

    bucket = F.shiftright("_key", BUCKET_SHIFT)
    in_bucket = Window.partitionBy("source", "_bucket").orderBy("_key", "doc_id", "size", "text_key").rowsBetween(Window.unboundedPreceding, 0)
    rows = sized.withColumn("_bucket", bucket)
    starts = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_n"))
    starts = starts.select("source", "_bucket", (F.sum("_n").over(Window.partitionBy("source").orderBy("_bucket")) - F.col("_n")).alias("_before"))
    same_bucket = F.col("d.source").eqNullSafe(F.col("b.source")) & (F.col("d._bucket") == F.col("b._bucket"))
    placed = rows.withColumn("_end", F.sum("size").over(in_bucket)).alias("d").join(starts.alias("b"), same_bucket)
    placed = placed.select("d.source", "doc_id", "text_key", "size", (F.col("_before") + F.col("_end") - F.col("size")).alias("_at"))
    placed = placed.alias("p").join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source"))).select("p.*", "source_size", "target")
    placed = materialize(placed)

    # The stream of a source is its shuffled documents, `repeats` times over; a piece is what one block has of one document.
    pieces = (
        placed.where("size > 0")
        .withColumn("_start", F.explode(F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda e: F.col("_at") + e * F.col("source_size"))))
        .withColumn("_stop", F.least(F.col("_start") + F.col("size"), F.ceil("target")))
        .where("_start < _stop")
        .withColumn("rank", F.explode(F.sequence(F.floor(F.col("_start") / block), F.floor((F.col("_stop") - 1) / block))))
        .select("source", "_at", "rank", (F.least("_stop", (F.col("rank") + 1) * block) - F.greatest("_start", F.col("rank") * block)).alias("_words"))
    )
    same_block = F.col("x.source").eqNullSafe(F.col("s.source")) & (F.col("x.rank") == F.col("s.rank"))
    taken = pieces.alias("x").join(schedule.alias("s"), same_block).groupBy("x.source", "_at").agg(F.sum("_words").alias("taken"))
    same_doc = F.col("p.source").eqNullSafe(F.col("k.source")) & (F.col("p._at") == F.col("k._at")) & (F.col("p.size") > 0)
    takes = placed.alias("p").join(taken.alias("k"), same_doc, "left").select(
        "doc_id", "p.source", "text_key", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken")
    )
    return Mix(targets, schedule, takes, block)
