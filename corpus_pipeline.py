"""A training corpus out of raw documents, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the one before it
kept, and is written as Parquet before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, importance, line_dedup, mixing, ngram_join
from plumbline.llm.common import table, whole_text
from plumbline.llm.queries import vocabulary
from plumbline.scratch import materialize


def _aside(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, list]:
    """``docs`` with its columns of ``names``, which an operator makes itself, called otherwise; and what gives them their names back."""
    called = {c: f"{c} of the row" if c in names else c for c in docs.columns}
    return docs.withColumnsRenamed(called), [F.col(f"`{new}`").alias(c) for c, new in called.items()]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that importance resampling draws.

    Documents without words, null and empty texts among them, are never drawn.
    Equal rows share a draw. Texts count whole, whatever their length. Without
    labels all documents that have words stay. An empty table stays empty, and
    other columns are kept, whatever their names.
    """
    target, share = importance.labelled_target(docs, table(spark, sf_dir, "labels"))
    rows, back = _aside(docs, ("n_grams", "log_weight", "priority", "kept"))
    return importance.resample(rows, target, share, keep_rows=True).where("kept").select(back)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out cross-site lines; documents of which nothing is left go.

    Null and empty texts, in which there is no line to take out, stay as they
    are. Equal rows are changed alike, lines and texts of any length are whole,
    an empty table stays empty, and other columns are kept, whatever their names.
    n_chars counts anew where lines went.
    """
    rows, back = _aside(docs, ("n_lines", "n_removed"))
    cleaned = line_dedup.dedup_lines(rows)
    left = cleaned.where((F.col("n_removed") == 0) | (F.btrim(whole_text(), F.lit(" \t\n\x0b\x0c\r")) != ""))
    counted = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", counted).select(back)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near duplicates.

    That is the row of the least doc_id. Documents without words, null texts among them, are no
    one's duplicates. Of equal rows one stays. Texts are compared whole, an
    empty table stays empty, and other columns are kept, whatever their names.
    """
    return ngram_join.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and leave out documents by the schedule; a document goes in as often as the words taken make whole ones, rounded.

    Documents without words are never taken. A null source is a source, and null
    ids are documents like others. Equal rows have takes of their own; the rows
    that they stand for are equal. Texts of any length count whole, an empty table
    stays empty, and other columns are kept, whatever their names.
    """
    takes = mixing.mix_sources(docs).takes.where("size > 0")
    times = takes.groupBy("doc_id", "source", "text_key", "size").agg(F.sum(F.floor(F.col("taken") / F.col("size") + 0.5)).alias("times"), F.count("*").alias("rows"))
    times = materialize(times.where("times > 0"))
    # The row is one column beside the others, so that no name of it can clash.
    packed = docs.select(F.struct("*").alias("row"), F.xxhash64(whole_text()).alias("key")).alias("d")
    same = F.col("row.doc_id").eqNullSafe(F.col("t.doc_id")) & F.col("row.source").eqNullSafe(F.col("t.source")) & (F.col("key") == F.col("t.text_key"))
    joined = packed.join(times.alias("t"), same)
    if not times.where("rows > 1").isEmpty():
        joined = joined.dropDuplicates(["doc_id", "source", "text_key"])
    return joined.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times")))).select([F.col("row")[c].alias(c) for c in docs.columns])


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode whole texts to token ids, and check that they decode to the text.

    Null and empty texts have no tokens. Equal rows are encoded alike, texts of
    any length whole; an empty table stays empty, and other columns are left out.
    """
    rows = docs.select("doc_id", "lang", "source", "n_chars", "text", F.sha2(whole_text(), 256).alias("sha"))
    coded = bpe.encode_documents(rows, *vocabulary(), decoded="decoded")
    return coded.select("doc_id", "lang", "source", "n_chars", F.floor(F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), "token_ids", (F.sha2("decoded", 256) == F.col("sha")).alias("round_trip"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_stage),
    ("ngram_join", ngram_join_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: Hash models, MinHash groups and merges of tokens are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
