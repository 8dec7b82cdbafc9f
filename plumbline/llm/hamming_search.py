"""Exact top-k search in Hamming space by incremental multi-index hashing.

Codes are cut into segments. Each round looks up, for the queries that are not
done, the segment values at the next distance from their own, and verifies the
whole codes found. After the values up to distance r of the first j + 1 of m
segments, and up to r - 1 of the others, every code within m r + j bits has
been seen; a query is done when its k-th distance is covered so, and its last
round looks at no more segments than that takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import discard, let, materialize

WORD = 64


def sign_code(vector: Column, n_words: int) -> Column:
    """Bit i is set where element i is positive; words of 64 bits, array<bigint>."""

    def word(v: Column, w: Column) -> Column:
        part = F.slice(v, w * WORD + 1, WORD)
        bits = F.transform(part, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
        return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))

    return let(vector, lambda v: F.transform(F.sequence(F.lit(0), F.lit(n_words - 1)), lambda w: word(v, w)))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)


def segments(n_words: int, bits: int) -> list[tuple[int, int, int]]:
    """(word, shift, width) of segments of at most ``bits`` bits that cover all words."""
    parts = max(1, -(-WORD // bits))
    widths = [WORD // parts + (i < WORD % parts) for i in range(parts)]
    return [(w, sum(widths[:i]), widths[i]) for w in range(n_words) for i in range(parts)]


def _values(code: Column, segs: list[tuple[int, int, int]]) -> list[Column]:
    return [F.shiftrightunsigned(code[w], s).bitwiseAND(F.lit((1 << n) - 1)) for w, s, n in segs]


def _flipped(cells: DataFrame, radius: int) -> DataFrame:
    """Each of ``cells`` (seg, width, value, ...) once for each way to flip ``radius`` of the ``width`` bits of its value.

    The bits are chosen one after the other, from the lowest, as rows: nothing of
    the size of all choices is held anywhere.
    """
    keep = [c for c in cells.columns if c != "value"]
    rows = cells.withColumn("bit", F.lit(-1))
    for left in range(radius - 1, -1, -1):
        first, last = F.col("bit") + 1, F.col("width") - 1 - left
        rows = rows.select(*keep, "value", F.explode(F.when(first <= last, F.sequence(first, last))).alias("bit"))
        rows = rows.select(*keep, F.col("value").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))).alias("value"), "bit")
    return rows.drop("bit")


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` to each row of ``queries`` by sign codes: query_id, rank, vec_id, distance.

    Exact: rows of least distance, ties by id (null last), a query's own row
    among them. Vectors that are null or empty have no code and take no part;
    elements that are null or not numbers count as not positive, missing ones
    as such too. Equal codes are searched once and keep their ``k`` least ids;
    repeated rows count as rows. With fewer than ``k`` rows all are returned.
    Empty tables give no rows, and other columns are ignored.
    """
    n_words = max(1, -(-(vectors.unionByName(queries.select(vectors.columns)).agg(F.max(F.size(vector))).first()[0] or 0) // WORD))
    code = sign_code(F.col(vector), n_words)
    rows = vectors.where(F.size(vector) > 0).select(F.col(vec_id).alias("id"), code.alias("code"))
    # The k least ids of a code; Spark cuts groups down before and after the shuffle.
    by_id = Window.partitionBy("code").orderBy(F.col("id").asc_nulls_last())
    first = rows.withColumn("_n", F.row_number().over(by_id)).where(F.col("_n") <= k)
    codes = materialize(first.groupBy("code").agg(F.sort_array(F.collect_list(F.struct(F.col("id").isNull().alias("last"), "id"))).alias("ids")))
    asked = materialize(queries.where(F.size(vector) > 0).select(F.col(vec_id).alias("query_id"), code.alias("query")))
    n_codes = codes.count()
    # 16 bits, and log2(n) beyond: a value has few codes, and few values are near it.
    segs = segments(n_words, min(32, max(16, n_codes.bit_length())))
    cells = [F.struct(F.lit(i).alias("seg"), v.alias("value")) for i, v in enumerate(_values(F.col("code"), segs))]
    index = materialize(codes.select("code", "ids", F.explode(F.array(*cells)).alias("c")).select("c.seg", "c.value", "code", "ids"))

    best = None
    active = asked.select("query").distinct().withColumn("kth", F.lit(n_words * WORD))
    for radius in range(max(n for *_, n in segs) + 1):
        own = _values(F.col("query"), segs)
        cells = F.array(*[F.struct(F.lit(i).alias("seg"), F.lit(width).alias("width"), own[i].alias("value")) for i, (_, _, width) in enumerate(segs)])
        # No code outside the first kth - m r + 1 segments' values can be nearer than the k-th.
        enough = F.greatest(F.col("kth") - len(segs) * radius + 1, F.lit(1)).cast("int")
        asked_cells = active.select("query", "kth", F.explode(F.slice(cells, F.lit(1), enough)).alias("c")).select("query", "kth", "c.seg", "c.width", "c.value")
        # Queries and segments are dealt to all tasks before they grow into probes.
        probed = _flipped(asked_cells.repartition("query", "seg"), radius).select("query", "kth", "seg", "value")
        # The probes are many more than the planner takes them for, so it must not broadcast them.
        met = probed.join(index.hint("merge"), ["seg", "value"]).withColumn("distance", hamming(F.col("query"), F.col("code"))).where("distance <= kth")
        # A code is met in each segment at this radius; the first of those counts, and none that an earlier radius had.
        apart = [F.bit_count(a.bitwiseXOR(b)) for a, b in zip(own, _values(F.col("code"), segs), strict=True)]
        new = F.lit(True)
        for i, d in enumerate(apart):
            new = new & ((d > radius) | ((d == radius) & (F.col("seg") <= i)))
        fresh = met.where(new).select("query", "distance", F.explode("ids").alias("x")).select("query", "distance", "x.last", "x.id")
        every = fresh if best is None else best.drop("n").unionByName(fresh)
        order = Window.partitionBy("query").orderBy("distance", "last", "id")
        old, best = best, materialize(every.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k))
        if old is not None:
            discard(old)
        kth = best.where(F.col("n") == k).select("query", F.col("distance").alias("at"))
        # A query whose last k-th distance was within reach of this round is done, since its k-th has only come nearer.
        reach = len(segs) * (radius + 1) - 1
        left = active.where(F.col("kth") > reach).select("query").join(kth, "query", "left")
        active = materialize(left.where(F.col("at").isNull() | (F.col("at") > reach)).select("query", F.coalesce("at", F.lit(n_words * WORD)).alias("kth")))
        if active.isEmpty():
            break
    if best is None:
        raise AssertionError("there is a segment")
    return asked.join(best, "query").select("query_id", F.col("n").alias("rank"), F.col("id").alias("vec_id"), F.col("distance").cast("int").alias("distance"))
