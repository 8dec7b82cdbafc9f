"""Quality classifier by importance resampling.

Two generative models over hashed word n-grams, one of target documents and
one of the raw text, give each document an importance weight; Gumbel noise on
its logarithm and a top-k draw a sample without replacement.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import materialize, release, small_batches, whole_text
from plumbline.llm.shingles import blocks, gram_hashes, word_hashes

BUCKETS = 1 << 14


def _buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of each word and each pair of words."""
    words, counts = word_hashes(texts)
    pairs, pair_counts = gram_hashes(words, counts, 2)
    of = lambda c: np.repeat(np.arange(len(texts)), np.diff(c))
    grams = np.concatenate([words, pairs])
    return (grams & np.uint64(BUCKETS - 1)).astype(np.int64), np.concatenate([of(counts), of(pair_counts)])


def bucket_counts(docs: DataFrame, text: str) -> np.ndarray:
    """Occurrences of each bucket over whole ``docs``: a row a task and bucket are added up, and BUCKETS counts come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in blocks(batch, "text"):
                total += np.bincount(_buckets(part.column(0))[0], minlength=BUCKETS)
        release()
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    rows = docs.select(whole_text(text).alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def log_ratios(target: np.ndarray, raw: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """log of target over raw probability of each bucket, both smoothed."""
    t = (target + smoothing) / (target.sum() + smoothing * len(target))
    r = (raw + smoothing) / (raw.sum() + smoothing * len(raw))
    return np.log(t / r)


def score_documents(docs: DataFrame, ratios: np.ndarray, text: str) -> DataFrame:
    """Add ``n_grams`` and ``log_weight``, the sum of the log ratios of the n-grams; ``text`` itself goes."""
    keep = [c for c in docs.columns if c != text]
    schema = docs.select(*keep, F.lit(0).cast("long").alias("n_grams"), F.lit(0.0).alias("log_weight")).schema
    spread = docs.sparkSession.sparkContext.broadcast(ratios)  # BUCKETS doubles, whatever the corpus

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, text):
                bucket, owner = _buckets(part.column(text))
                n = np.bincount(owner, minlength=len(part))
                w = np.bincount(owner, spread.value[bucket], minlength=len(part))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(n, pa.int64()), pa.array(w, pa.float64())], [*keep, "n_grams", "log_weight"])
        release()

    return docs.select(*keep, text).mapInArrow(score, schema)


def gumbel(keys: list[Column], seed: int) -> Column:
    """Standard Gumbel noise that a document has in every run."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


def top_k_threshold(keys: DataFrame, column: str, k: int, bits: int = 12) -> int | None:
    """The k-th largest value of a long column, exactly, without a sort; None if there are fewer than k rows.

    Each round counts the rows by the next ``bits`` bits below the prefix found
    so far: at most 2**bits counts a round come to the driver.
    """
    if k <= 0:
        return None
    # Offset to an unsigned order, in two parts that fit a long.
    shift, prefix, left = 64, 0, k
    rows = keys.select(F.col(column).bitwiseXOR(F.lit(-(1 << 63))).alias("_v"))
    while shift:
        step = min(bits, shift)
        shift -= step
        digit = F.shiftrightunsigned("_v", shift).bitwiseAND(F.lit((1 << step) - 1))
        at = rows if shift + step == 64 else rows.where(F.shiftrightunsigned("_v", shift + step) == F.lit(prefix))
        counts = {r.d: r.n for r in at.groupBy(digit.alias("d")).agg(F.count("*").alias("n")).collect()}
        for d in sorted(counts, reverse=True):
            if left <= counts[d]:
                prefix = (prefix << step) | d
                break
            left -= counts[d]
        else:
            return None
    value = prefix ^ (1 << 63)
    return value - (1 << 64) if value >= 1 << 63 else value


def resample(docs: DataFrame, target: DataFrame, share: float, text: str = "text", doc_id: str = "doc_id", temperature: float = 1.0, seed: int = 17, keep_rows: bool = False) -> DataFrame:
    """Draw ``share`` of ``docs`` by importance: doc_id, n_grams, log_weight, priority and kept.

    ``target`` has the texts of target documents in a column ``text``; the raw
    model counts all of ``docs``. ``kept`` marks the k = round(share x rows)
    rows of highest priority, the log weight plus Gumbel noise; equal rows have
    equal priorities and share a draw, so ties at the last place are all kept.
    Documents without words, null texts among them, have no evidence: they are
    not drawn and don't count in k. An empty table gives no rows, an empty
    target keeps all that have words. Texts of any length count whole. Other
    columns are ignored; with ``keep_rows`` the columns of ``docs`` are returned
    with n_grams, log_weight, priority and kept (which replace columns of those
    names), and the texts are scored a second time rather than joined.
    """
    small_batches(docs.sparkSession)
    made = ["n_grams", "log_weight", "priority", "kept"]
    kept = [c for c in docs.columns if c not in made]
    noise = gumbel([F.coalesce(F.col(doc_id), F.lit(-1).cast("long")), F.xxhash64(whole_text(text))], seed).alias("_noise")
    # The row is one column beside those made here, so that no name of it can clash.
    rows = docs.select(F.struct(*kept).alias("row") if keep_rows else F.col(doc_id).alias("doc_id"), noise, whole_text(text).alias("_scored"))
    wanted = bucket_counts(target, "text")
    ratios = log_ratios(wanted, bucket_counts(rows, "_scored")) if wanted.any() else np.zeros(BUCKETS)

    def ranked(r: DataFrame) -> DataFrame:
        scored = score_documents(r, ratios, "_scored").withColumn("priority", F.when(F.col("n_grams") > 0, F.col("log_weight") / temperature + F.col("_noise"))).drop("_noise")
        # Fixed point of 2**-16 keeps the order of priorities in a long.
        return scored.withColumn("_rank", F.round(F.col("priority") * 65536).cast("long"))

    narrow = materialize(ranked(rows.select("_noise", "_scored") if keep_rows else rows))
    worded = narrow.where("n_grams > 0")
    least = top_k_threshold(worded, "_rank", round(share * worded.count())) if wanted.any() else None
    out = ranked(rows) if keep_rows else narrow
    chosen = F.col("_rank") >= F.lit(least) if least is not None else F.lit(not wanted.any())
    marks = ["n_grams", "log_weight", "priority", ((F.col("n_grams") > 0) & F.coalesce(chosen, F.lit(False))).alias("kept")]
    return out.select(*([F.col("row")[c].alias(c) for c in kept] if keep_rows else ["doc_id"]), *marks)


def labelled_target(docs: DataFrame, labels: DataFrame, max_rows: int = 50_000) -> tuple[DataFrame, float]:
    """Texts of labelled documents of good quality that aren't toxic, and the share of good quality among all labelled ones.

    The target texts are of at most ``max_rows`` labelled documents, those of
    least hash of their id where there are more; the share is over all labels. A
    document with several labels is good if one of them says so. The chosen ids
    are bounded by ``max_rows``, so they go to the documents by broadcast, and
    no text is dealt anew.
    """
    good = F.col("quality") == 1
    one = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max(F.when(good, 1).otherwise(0)).alias("good"), F.max(F.when(good & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0)).alias("target"))
    n, n_good = one.agg(F.count("*"), F.coalesce(F.sum("good"), F.lit(0))).first()
    # A top-k by limit: each task hands on max_rows ids at most.
    chosen = one.where("target = 1").select(F.col("doc_id").alias("_id")).orderBy(F.xxhash64(F.lit("target"), "_id"), "_id").limit(max_rows)
    texts = docs.select(F.col("doc_id").alias("_doc"), "text").join(F.broadcast(chosen), F.col("_doc") == F.col("_id"), "left_semi").select("text")
    return texts, n_good / n if n else 1.0
