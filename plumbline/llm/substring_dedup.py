"""Substring dedup by content-defined chunks and exact windows of words.

A gear hash rolls over the words of a text and cuts it where it is least
nearby, so a passage is cut alike wherever it stands, whatever was inserted
before it. Chunks are deduplicated by digest. Any passage of enough words holds
a whole chunk, so chunks that occur twice say where windows may repeat; there
every window is compared by 96-bit digest. What repeated windows cover are
passages; all but the first occurrence can go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import discard, materialize, release, small_batches, text_key, whole_text
from plumbline.llm.shingles import blocks, gram_hashes, mix, text_bytes, word_hashes

#: An odd multiplier of the chunks' digests.
ODD = np.uint64(0x9E3779B97F4A7C15)

#: What is known of windows before they are compared: that they occur again, that a run of
#: them is first wherever it occurs, and that a run of them has earlier occurrences.
REPEATED, FIRST, LATER = 1, 2, 3


def chunk_words(min_words: int) -> tuple[int, int]:
    """(words that the gear hash sees, hashes of which the least cuts).

    ``min_words`` words have as many hashes as two such ranges or more, hence two
    cuts that depend on nothing else, and the chunk between them.
    """
    if min_words < 2:
        raise ValueError("min_words must be 2 or more")
    seen = max(1, min_words // 5)
    return seen, (min_words + 1 - seen) // 2


def gear_hashes(words: np.ndarray, seen: int) -> np.ndarray:
    """The rolling hash after each word: shifted for every word, so that one leaves after ``seen`` words."""
    shift = np.uint64(-(-64 // seen))
    h = words.copy()
    for k in range(1, seen):
        h[k:] += words[:-k] << (shift * np.uint64(k))
    return mix(h)


def cuts(words: np.ndarray, counts: np.ndarray, min_words: int) -> np.ndarray:
    """Words after which a text is cut: of each range of gear hashes the least, the last of equal ones."""
    seen, among = chunk_words(min_words)
    owner = np.repeat(np.arange(len(counts) - 1), np.diff(counts))
    whole = np.flatnonzero(np.arange(len(words)) - counts[owner] >= seen - 1)
    h, owner = gear_hashes(words, seen)[whole], owner[whole]
    total = max(len(h) - among + 1, 0)
    least, at = h[:total].copy(), np.arange(total)
    for j in range(1, among):
        lower = h[j : j + total] <= least
        least[lower] = h[j : j + total][lower]
        at[lower] = np.flatnonzero(lower) + j
    return whole[np.unique(at[owner[:total] == owner[among - 1 : among - 1 + total]])]


def chunks(texts: pa.Array, min_words: int) -> tuple[np.ndarray, ...]:
    """(row, place, words, digest) of the chunks; places in words.

    A chunk goes from one cut to the next, and begins with the words that its
    first cut's hash saw. What stands before a text's first cut and after its
    last is shorter than a passage.
    """
    words, counts = word_hashes(texts)
    at = cuts(words, counts, min_words)
    owner = np.searchsorted(counts, at, "right") - 1
    same = owner[1:] == owner[:-1]
    row = owner[1:][same]
    first, size = at[:-1][same] - chunk_words(min_words)[0] + 1, np.diff(at)[same] + chunk_words(min_words)[0]
    digest = np.zeros(len(row), np.uint64)
    for k in range(int(size.max(initial=0))):
        live = size > k
        digest[live] = mix(digest[live] * ODD + words[first[live] + k])
    return row, first - counts[row], size, digest.view(np.int64)


def windows(texts: pa.Array, number: np.ndarray, row: np.ndarray, place: np.ndarray, size: np.ndarray, whole: np.ndarray, min_words: int) -> tuple[np.ndarray, ...]:
    """(row, start, end, start of the next word, state, digest 1, digest 2) of the windows of words that hold one of the chunks (row, place, size).

    Of windows that occur more than once here, the one of the least text ``number`` and place
    is REPEATED, and the others come as runs that are LATER. Other windows in ``whole`` rows
    come as runs that are FIRST. The digests of a run are its own. Starts and ends are in
    code points; the text's end stands for a next word that isn't there.
    """
    data, offsets = text_bytes(texts)
    words, counts = word_hashes(texts)
    d1, ends = gram_hashes(words, counts, min_words)
    d2 = gram_hashes(mix(words ^ np.uint64(0x5851F42D4C957F2D)), counts, min_words)[0] >> np.uint64(32)
    owner = np.repeat(np.arange(len(texts)), np.diff(ends))
    change = np.zeros(len(d1) + 1, np.int64)
    begin, stop = ends[row] + np.maximum(place + size - min_words, 0), np.minimum(ends[row] + place + 1, ends[row + 1])
    np.add.at(change, begin[begin < stop], 1)
    np.add.at(change, stop[begin < stop], -1)
    held = np.cumsum(change[:-1]) > 0
    chosen = np.flatnonzero(held)
    of = owner[chosen]
    at = chosen - ends[of]
    order = np.lexsort((at, number[of], d2[chosen], d1[chosen]))
    x = chosen[order]
    opens_group = np.ones(len(x), bool)
    opens_group[1:] = (d1[x[1:]] != d1[x[:-1]]) | (d2[x[1:]] != d2[x[:-1]])
    lead = order[np.flatnonzero(opens_group)[np.cumsum(opens_group) - 1]] if len(x) else order
    # Rows of equal id and text share number and place: neither is later than the other.
    behind = (number[of[order]] != number[of[lead]]) | (at[order] != at[lead])
    state = np.where(whole[of], REPEATED, 0)
    state[lead[behind]] = REPEATED
    state[order[behind]] = LATER
    alone = state != LATER
    rest = np.flatnonzero(~held & whole[owner])

    def runs(among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        apart = np.ones(len(among) + 1, bool)
        apart[1:-1] = (np.diff(among) > 1) | (np.diff(owner[among]) > 0)
        return among[apart[:-1]], among[apart[1:]]

    (unique, unique_ends), (later, later_ends) = runs(rest), runs(chosen[~alone])
    begun, ended = np.concatenate([chosen[alone], unique, later]), np.concatenate([chosen[alone], unique_ends, later_ends])
    state = np.concatenate([state[alone], np.full(len(unique), FIRST), np.full(len(later), LATER)])
    of = owner[begun]
    solid = ~np.isin(data, np.array([0x20, 9, 10, 11, 12, 13], np.uint8))
    opens = np.zeros(len(data) + 1, bool)
    opens[offsets] = True
    begins, stops = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1] | opens[1:-1]
    stops[:-1] &= ~solid[1:] | opens[1:-1]
    a, b = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    first, last = counts[of] + begun - ends[of], counts[of] + ended - ends[of] + min_words - 1
    after = np.where(last + 1 < counts[of + 1], np.append(a, 0)[np.minimum(last + 1, len(a))], offsets[of + 1])
    start, end, after = (chars[x] - chars[offsets[of]] for x in (a[first], b[last], after))
    own = mix(mix(number[of].astype(np.uint64) ^ ODD) + (begun - ends[of]).astype(np.uint64))
    run = state >= FIRST
    d1, d2 = np.where(run, own, d1[begun]), np.where(run, mix(own ^ ODD) >> np.uint64(32), d2[begun])
    return of, start, end, after, state, d1.view(np.int64), d2.astype(np.uint32).view(np.int32)


def union(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans, sorted, that cover the same as the given ones and don't touch."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    cut = np.flatnonzero(start[1:] > end[:-1])
    return start[np.append(0, cut + 1)[: len(start)]], end[np.append(cut, len(end) - 1)[: len(end)]]


def removable_spans(start: np.ndarray, end: np.ndarray, after: np.ndarray, is_first: np.ndarray) -> list[tuple[int, int]]:
    """What windows that aren't first cover and first ones don't; white space after a first window is left with it."""
    keep_from, keep_to = union(start[is_first], after[is_first])
    out = []
    for a, b in zip(*(x.tolist() for x in union(start[~is_first], end[~is_first])), strict=True):
        for i in range(int(np.searchsorted(keep_to, a, "right")), int(np.searchsorted(keep_from, b))):
            if keep_from[i] > a:
                out.append((a, int(keep_from[i])))
            a = int(keep_to[i])
        if a < b:
            out.append((a, b))
    return out


def _chunked(docs: DataFrame, min_words: int) -> DataFrame:
    """(k, at, h, known) of each chunk of (k, text): at = place << 8 | words, and the digest h.

    A digest at several places of a block of texts comes once; the other places are
    ``known`` to repeat it and have digests of their own, so that a digest's group
    has a row a block at most.
    """
    if chunk_words(min_words)[0] + chunk_words(min_words)[1] > 255:
        raise ValueError("min_words is too large")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text", 1_000_000):
                row, place, size, digest = chunks(part.column("text"), min_words)
                k, at = part.column("k").to_numpy(zero_copy_only=False).astype(np.int64)[row], place << 8 | size
                order = np.lexsort((at, k, digest))
                k, at, digest = k[order], at[order], digest[order]
                same = digest[1:] == digest[:-1]
                # Chunks of equal texts at one place are one.
                moved = np.append(True, (k[1:] != k[:-1]) | (at[1:] != at[:-1]) | ~same)[: len(k)]
                k, at, digest = k[moved], at[moved], digest[moved]
                again = np.append(False, digest[1:] == digest[:-1])[: len(k)]
                known = again.copy()
                known[:-1] |= again[1:]
                own = mix(mix(k.view(np.uint64) ^ ODD) + at.astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(at), pa.array(np.where(again, own, digest)), pa.array(known)], ["k", "at", "h", "known"])
        release()

    return docs.mapInArrow(run, "k long, at long, h long, known boolean")


def _windowed(docs: DataFrame, min_words: int) -> DataFrame:
    """(n, piece, gap, d1, d2) of the windows around ``places`` of (n, text, places, copied).

    piece is start << 32 | end, gap the characters from the end to the next word,
    times 4, and the state.
    """
    names = ["n", "piece", "gap", "d1", "d2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text", 1_000_000):
                places = part.column("places")
                copied = part.column("copied").to_numpy(zero_copy_only=False).astype(bool)
                number = part.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(len(part)), places.value_lengths().to_numpy(zero_copy_only=False))
                at = places.flatten().to_numpy().astype(np.int64)
                of, start, end, after, state, d1, d2 = windows(part.column("text"), number, row, at >> 8, at & 255, copied, min_words)
                yield pa.RecordBatch.from_arrays([pa.array(number[of]), pa.array(start << 32 | end), pa.array((after - end) * 4 + state, pa.int64()), pa.array(d1), pa.array(d2)], names)
        release()

    return docs.mapInArrow(run, "n long, piece long, gap long, d1 long, d2 int")


def _spans(by_doc: DataFrame) -> DataFrame:
    """(n, repeated, removable) of (n, pieces)."""
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shown = lambda pairs: [{"start": a, "end": b} for a, b in pairs]
        for batch in batches:
            pieces = batch.column("pieces")
            ends = np.cumsum(pieces.value_lengths().to_numpy(zero_copy_only=False)).tolist()
            flat = pieces.flatten()
            piece, gap, is_first = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            start, end = piece >> 32, piece & 0xFFFFFFFF
            repeated, removable = [], []
            for a, b in zip([0, *ends], ends, strict=False):
                repeated.append(shown(zip(*(x.tolist() for x in union(start[a:b], end[a:b])), strict=True)))
                removable.append(shown(removable_spans(start[a:b], end[a:b], end[a:b] + gap[a:b], is_first[a:b])))
            yield pa.RecordBatch.from_arrays([batch.column("n"), pa.array(repeated, spans), pa.array(removable, spans)], ["n", "repeated", "removable"])

    kind = "array<struct<start:bigint,end:bigint>>"
    return by_doc.mapInArrow(run, f"n long, repeated {kind}, removable {kind}")


def repeated_passages(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = 20) -> DataFrame:
    """Passages of ``min_words`` words or more that occur more than once, for each document that has any.

    Returns doc_id, k (a hash of the text), ``repeated`` and ``removable``: spans
    (start, end) in code points of what windows of ``min_words`` words cover that
    occur more than once, and of what those of them cover that have an earlier
    occurrence, by document id (null last), text and place, but no first one, so
    that each window stays whole in its first occurrence. Words are compared, not
    the white space between them. Equal texts are compared with others once, and
    the copies' rows say the same of all of them. Rows with equal id and text share
    one row and keep their first occurrence. Texts of any length are whole. Null and empty texts and an empty table give
    nothing; other columns are ignored.
    """
    key, other = text_key(whole_text(text))
    source = docs.select(F.col(doc_id).alias("doc_id"), key.alias("k"), other.alias("k2"), whole_text(text).alias("text"))
    small_batches(docs.sparkSession)
    # Equal texts are one: the row of the least id stands for its copies, whose windows all have an earlier occurrence.
    keyed = materialize(source.groupBy("doc_id", "k", "k2").agg(F.count("*").alias("rows")))
    last = F.col("doc_id").isNull()
    texts = keyed.groupBy("k", "k2").agg(F.min(F.struct(last.alias("last"), "doc_id")).alias("first"), (F.sum("rows") > 1).alias("copied")).select("k", "k2", "first.doc_id", "copied")
    # n numbers them in the order of occurrences.
    texts = materialize(texts.orderBy(last, "doc_id", "k").withColumn("n", F.monotonically_increasing_id()))
    place, alike = F.xxhash64("k", "at"), Window.partitionBy("h")
    repeats = F.max("known").over(alike) | (F.min(place).over(alike) != F.max(place).over(alike))
    every = _chunked(source.select("k", "text"), min_words).withColumn("repeats", repeats)
    places = every.where("repeats").groupBy("k").agg(F.collect_set("at").alias("places"))
    held = texts.join(places, "k", "left").where(F.col("places").isNotNull() | F.col("copied"))
    held = materialize(held.select("n", "doc_id", "k", F.coalesce("places", F.array().cast("array<bigint>")).alias("places"), "copied"))
    wanted = source.alias("s").join(held.alias("p"), F.col("s.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("s.k") == F.col("p.k")))
    # A digest has a row a block of texts at most, so one shuffle finds what repeats and which is first.
    state, where, alike = F.col("gap").bitwiseAND(3), F.struct("n", "piece"), Window.partitionBy("d1", "d2")
    found = _windowed(wanted.select("n", "text", "places", "copied"), min_words)
    found = found.select("n", "piece", "gap", (F.count("*").over(alike) > 1).alias("again"), F.min(where).over(alike).alias("first"))
    is_first = (state == FIRST) | ((state != LATER) & (where == F.col("first")))
    piece = F.struct("piece", F.shiftright("gap", 2).alias("gap"), is_first.alias("is_first")).alias("piece")
    pieces = found.where(F.col("again") | (state > 0)).select("n", piece)
    spans = _spans(pieces.groupBy("n").agg(F.collect_list("piece").alias("pieces")))
    spans = materialize(spans.join(texts.select("n", "doc_id", "k"), "n").select("doc_id", "k", "repeated", "removable"))
    discard(held)
    first = texts.where("copied").select("k", "k2", F.col("doc_id").alias("first_id"))
    # Nothing is grouped after this join, so that a text with very many copies can be split.
    copies = keyed.drop("rows").join(first, ["k", "k2"]).where(~F.col("doc_id").eqNullSafe(F.col("first_id")))
    whole = copies.alias("c").join(spans.alias("r"), (F.col("c.k") == F.col("r.k")) & F.col("c.first_id").eqNullSafe(F.col("r.doc_id")))
    return spans.unionByName(whole.select("c.doc_id", "c.k", "repeated", F.col("repeated").alias("removable")))


def remove_passages(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = 20) -> DataFrame:
    """``docs`` with the removable passages taken out of ``text``; texts without any, null ones among them, stay as they are.

    Other columns are kept, whatever their names.
    """
    passages = materialize(repeated_passages(docs, text, doc_id, min_words).where(F.size("removable") > 0).select("doc_id", "k", "removable"))
    # The row is one column beside the others, so that no name of it can clash.
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("id"), F.xxhash64(whole_text(text)).alias("key"))
    joined = rows.join(passages, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("k")), "left")
    old = F.col("row")[text]
    begins = F.concat(F.array(F.lit(0).cast("bigint")), F.transform("removable", lambda s: s["end"]))
    ends = F.concat(F.transform("removable", lambda s: s["start"]), F.array(F.length(old).cast("bigint")))
    left = F.array_join(F.zip_with(begins, ends, lambda a, b: F.substr(old, (a + 1).cast("int"), (b - a).cast("int"))), "")
    return joined.select(*[F.when(F.col("removable").isNull(), old).otherwise(left).alias(text) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
