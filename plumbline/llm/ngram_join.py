"""N-gram Jaccard join by MinHash banding.

Each text's set of word five-grams gets a MinHash signature, cut into bands.
Texts that share a band are brought together on the band's hash and linked into
candidate groups; within a group all pairs are verified on the full sets, in
blocks, and only counts and spanning links leave a task, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import materialize, release, small_batches, text_key, whole_text
from plumbline.llm.components import components
from plumbline.llm.shingles import blocks, gram_hashes, mix, unique_grams, word_hashes

WORDS = 5
#: Texts and n-grams of a block; a task verifies the pairs within or between two blocks.
BLOCK_TEXTS, BLOCK_GRAMS = 256, 1_000_000


def choose_bands(similarity: float, recall: float, rows: int = 5) -> int:
    """Fewest bands of ``rows`` values with which a pair of ``similarity`` shares one with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def signatures(grams: np.ndarray, counts: np.ndarray, bands: int, rows: int) -> pa.Array:
    """A list of a 64-bit hash for each band of each text; empty for a text without n-grams."""
    sizes = np.diff(counts)
    full = np.flatnonzero(sizes)
    starts = counts[full]
    hashed = np.zeros((bands, len(full)), np.uint64)
    for b in range(bands):
        for r in range(rows):
            # An odd multiplier permutes the 64-bit hashes.
            odd = mix(np.uint64([b * rows + r + 1]))[0] | np.uint64(1)
            if len(full):
                hashed[b] = mix(hashed[b] ^ np.minimum.reduceat(grams * odd, starts))
        hashed[b] = mix(hashed[b] + np.uint64(b))
    offsets = np.concatenate([[0], np.cumsum(np.where(sizes > 0, bands, 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(hashed.T).ravel().view(np.int64)))


def _key(text: Column) -> Column:
    a, b = text_key(text)
    return F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0"))


def _signed(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(doc_id, key, n_words, n_grams, bands) of (doc_id, key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                words, counts = word_hashes(part.column("text"))
                grams, ends = gram_hashes(words, counts, WORDS)
                made = [pa.array(np.diff(counts), pa.int64()), pa.array(np.diff(ends), pa.int64()), signatures(grams, ends, bands, rows)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), *made], ["doc_id", "key", "n_words", "n_grams", "bands"])
        release()

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key string, n_words long, n_grams long, bands array<long>")


def _gram_sets(texts: DataFrame) -> DataFrame:
    """Replace ``text`` by ``grams``, its distinct n-gram hashes as bytes."""
    keep = [c for c in texts.columns if c != "text"]
    schema = texts.select(*keep, F.lit(b"").alias("grams")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                grams, ends = unique_grams(*gram_hashes(*word_hashes(part.column("text")), WORDS))
                data, stops = grams.tobytes(), (ends * 8).tolist()
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array([data[a:b] for a, b in zip(stops, stops[1:], strict=False)], pa.binary())], [*keep, "grams"])
        release()

    return texts.mapInArrow(run, schema)


def verify(left: list[np.ndarray], right: list[np.ndarray] | None, similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each set i of ``left``, the indices of linked sets of ``right``; of later sets of ``left`` without it."""
    other = left if right is None else right
    sizes = np.array([len(s) for s in other])
    _, ids = np.unique(np.concatenate([*left, *(right or [])]), return_inverse=True)
    n_left = sum(map(len, left))
    pool = ids if right is None else ids[n_left:]
    starts = np.cumsum(sizes) - sizes
    own = np.cumsum([0, *map(len, left)])
    mark = np.zeros(ids.max(initial=0) + 1, np.int64)
    for i in range(len(left)):
        first = i + 1 if right is None else 0
        if first >= len(other):
            return
        mine = ids[own[i] : own[i + 1]]
        mark[mine] = 1
        shared = np.add.reduceat(mark[pool[starts[first] :]], starts[first:] - starts[first])
        mark[mine] = 0
        union = len(mine) + sizes[first:] - shared
        yield i, first + np.flatnonzero(shared >= similarity * union - 1e-9)


def _tile(similarity: float):
    def run(table: pa.Table) -> pa.Table:
        t1, t2 = table.column("t1")[0].as_py(), table.column("t2")[0].as_py()
        keys, copies, block = table.column("key").to_pylist(), np.array(table.column("copies").to_pylist()), np.array(table.column("block").to_pylist())
        sets = [np.frombuffer(g, np.uint64) for g in table.column("grams").to_pylist()]
        a = np.flatnonzero(block == t1)
        b = a if t1 == t2 else np.flatnonzero(block == t2)
        links, root = np.zeros(len(keys), np.int64), np.arange(len(keys))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        pairs = verify([sets[i] for i in a], None if t1 == t2 else [sets[i] for i in b], similarity) if len(a) and len(b) else ()
        for i, js in pairs:
            i, js = a[i], b[js]
            links[i] += copies[js].sum()
            links[js] += copies[i]
            for j in js:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
        out = np.flatnonzero(links)
        return pa.table({"key": pa.array([keys[i] for i in out], pa.string()), "root": pa.array([keys[find(i)] for i in out], pa.string()), "links": pa.array(links[out], pa.int64())})

    return run


def ngram_join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = 0.8, recall: float = 0.9999, rows: int = 5) -> DataFrame:
    """Link documents whose sets of five-word n-grams have a Jaccard similarity of ``similarity`` or more.

    Returns a row for each row of ``docs``: doc_id, key (of the text), n_copies (rows
    with the same text), n_links (other rows that are linked, copies among
    them) and class_id, the least doc_id of the connected class.

    Rows of one text are one class, whatever its length; texts under five words
    have no n-grams and no other links. Null texts and those without words are
    linked to nothing and are their own class. Null ids count as none in a class's least id, so a class of
    null ids only has a null class_id. An empty table gives no rows, and other
    columns of ``docs`` are ignored. Bands are chosen so that a pair at the
    threshold shares one with probability ``recall``; pairs of a candidate group
    are all verified, so that no link within it is lost.
    """
    small_batches(docs.sparkSession)
    bands = choose_bands(similarity, recall, rows)
    source = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text")).select("doc_id", _key(F.col("text")).alias("key"), "text")
    signed = materialize(_signed(source, bands, rows))
    worded = signed.where("n_words > 0")
    reps = materialize(worded.groupBy("key").agg(F.min("doc_id").alias("rep_id"), F.count("*").alias("copies"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands")))

    # The band's number is part of its hash.
    banded = reps.select("key", F.explode("bands").alias("h"))
    shared = banded.groupBy("h").agg(F.min("key").alias("least"), F.count("*").alias("n")).where("n > 1").select("h", "least")
    # The planner doesn't see how many rows the bands make, so it must not broadcast them.
    stars = banded.join(shared.hint("merge"), "h").where("key <> least").select(F.col("key").alias("a"), F.col("least").alias("b")).distinct()
    grouped = materialize(components(stars))
    groups = grouped.select(F.col("node").alias("key"), "root").unionByName(grouped.select(F.col("root").alias("key"), "root").distinct())

    members = materialize(reps.join(groups, "key").select("key", "rep_id", "copies", "n_grams", "root"))
    # Tables of their own on both sides of a join let Spark split a group or text with very many rows.
    sizes = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("n_grams") / BLOCK_GRAMS)).cast("int").alias("n_blocks"))
    members = materialize(members.join(materialize(sizes), "root").withColumn("block", F.pmod(F.xxhash64("key"), F.col("n_blocks")).cast("int")))
    repeated = worded.groupBy("key", "doc_id").count().where("count > 1")
    rows_differ = repeated.join(members.select("key"), "key", "left_semi").isEmpty()
    wanted = members.select(F.col("key").alias("k"), "rep_id", "copies", "root", "n_blocks", "block")
    # One row a text: that of its least id.
    texts = source.join(wanted, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("rep_id"))).drop("doc_id", "rep_id", "k")
    sets = _gram_sets(texts)
    if not rows_differ:
        sets = sets.dropDuplicates(["key"])
    tiled = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).select("key", "copies", "block", "grams", "root", F.least("block", "other").alias("t1"), F.greatest("block", "other").alias("t2"))
    found = materialize(tiled.groupBy("root", "t1", "t2").applyInArrow(_tile(similarity), "key string, root string, links long"))

    linked = found.groupBy("key").agg(F.sum("links").alias("links"))
    joined = materialize(components(found.select(F.col("key").alias("a"), F.col("root").alias("b"))))
    named = reps.select("key", "rep_id", "copies").join(linked, "key", "left").join(joined.withColumnsRenamed({"node": "key", "root": "class"}), "key", "left")
    named = named.withColumn("class", F.coalesce("class", "key"))
    least = named.groupBy("class").agg(F.min("rep_id").alias("class_id"))
    by_text = named.join(least, "class").select("key", "class_id", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    return signed.select("doc_id", "key", "n_words").join(by_text, "key", "left").select(
        "doc_id", "key",
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("n_words") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
    )


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one row of each class, the least by doc_id and then a hash of the text; rows without words all stay.

    Rows with a null id stay only where their class has no other id. Of equal
    rows one stays. Other columns are kept, whatever their names.
    """
    judged = ngram_join(docs, text, doc_id, **options)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key"))
    # A class of null ids only is its texts' own.
    classed = judged.withColumn("class", F.coalesce(F.col("class_id").cast("string"), "key"))
    chosen = materialize(classed.groupBy("class").agg(best.alias("b")).select(F.col("b.doc_id").alias("best_id"), F.col("b.key").alias("best_key")))
    repeated = not judged.groupBy("doc_id", "key").count().where("count > 1").isEmpty()
    # The row is one column beside the others, so that no name of it can clash.
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("id"), _key(whole_text(text)).alias("key"))
    out = rows.join(chosen, F.col("id").eqNullSafe(F.col("best_id")) & (F.col("key") == F.col("best_key")), "left_semi")
    if repeated:
        out = out.dropDuplicates(["id", "key"])
    return out.select([F.col("row")[c].alias(c) for c in docs.columns])
