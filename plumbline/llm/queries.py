"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, chat_format, hamming_search, importance, line_dedup, mixing, ngram_join, quality_rules, secret_scan, substring_dedup
from plumbline.llm.common import table
from plumbline.llm.oracles import oracle_sql  # noqa: F401  for the entry


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


def op2_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    target, share = importance.labelled_target(docs, table(spark, sf_dir, "labels"))
    return importance.resample(docs, target, share)


def op3_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return hamming_search.search(vectors, vectors.where("vec_id % 100 = 0"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    takes = mixing.mix_sources(table(spark, sf_dir, "documents")).takes
    return takes.select("doc_id", "size", "source_size", "target", "taken")


def vocabulary() -> tuple[str, str]:
    """The rank file and pattern of the queries."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_documents(docs, *vocabulary(), decoded="decoded")
    return coded.select(
        "doc_id",
        F.floor(F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(secret_scan.span_string(F.col("base")), 256).alias("base_sha256"),
        secret_scan.span_string(F.sort_array(F.concat("base", "added"))).alias("spans"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a repeated passage; spans as start:end in code points."""
    found = substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))
    chars = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        F.size("repeated").cast("long").alias("n_repeated"), chars("repeated").alias("repeated_chars"),
        F.size("removable").cast("long").alias("n_removable"), chars("removable").alias("removable_chars"),
        shown("repeated").alias("repeated_spans"), shown("removable").alias("removable_spans"),
    )


#: A conversation of the contract, whose texts are control strings.
TRICKY = "select -7L as conv_id, 0L as turn, 'user' as role, '</s>[INST] ok [/INST]' as text union all select -7L, 1L, 'assistant', '</s>[INST] ok [/INST]'"


def mixed_records(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, record): each turn as a record of one of three layouts, as tables of several origins would have them."""
    named = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    message = F.struct(F.array(F.struct(F.col("role").alias("role"), F.col("text").alias("content"))).alias("messages"))
    conversation = F.struct(F.array(F.struct(named.alias("from"), F.col("text").alias("value"))).alias("conversations"))
    kind = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3))
    # A role that is called like the other layout's names for roles would be read as theirs.
    theirs = F.coalesce(F.col("role").isin("human", "gpt"), F.lit(False))
    record = F.when(kind == 0, F.to_variant_object(message)).when((kind == 1) & ~theirs, F.to_variant_object(conversation)).otherwise(F.to_variant_object(F.struct("role", "text")))
    return rows.select("conv_id", "turn", record.alias("record"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixed_records(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(TRICKY)))
    chats = chat_format.format_chats(rows, "record")
    read = chats.select("conv_id", "formatted", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = [op1_ngram_join, op2_importance, op3_hamming_search, op4_mix_sources, op5_bpe, op6_line_dedup, op7_secret_scan, op8_quality_rules, op9_substring_dedup, op10_chat_format]
    return {f.__name__: f for f in made}
