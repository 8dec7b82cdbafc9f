"""Byte-level BPE encoding and decoding with DuckDB queries in each partition.

A partition's texts are cut into pre-tokens; the distinct ones of a block
become rows (word, position, token). A recursive query joins neighbouring
tokens with the merge table and contracts each word's leftmost pair of least
rank, all words at once, until no pair is left. Decoding joins tokens with the
vocabulary and puts the bytes together by an ordered aggregation.
"""

from __future__ import annotations

import base64
import tempfile
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import release, small_batches, whole_text

#: Characters of the texts that are encoded together; a longer text is a block of its own.
BLOCK_CHARS = 2_000_000
#: Words whose tokens a task remembers from block to block; beyond that it starts anew.
REMEMBERED = 300_000

#: Bytes up to which words are merged with all steps of a word held; longer ones hold their present tokens only.
LONG = 40

# A row knows the place and token of its next one, so no order of rows is taken for granted.
_MERGE = """
WITH RECURSIVE s(k, w, p, t, np, nt) AS (
  SELECT 0, w, p, t, np, nt FROM start
  UNION ALL
  (WITH best AS MATERIALIZED (SELECT w, min(m::BIGINT * 4294967296 + p) AS b FROM s JOIN merges ON lr = t::BIGINT * 4294967296 + nt WHERE nt >= 0 GROUP BY w),
   pick AS MATERIALIZED (SELECT s.w, s.p AS p0, (b // 4294967296)::INTEGER AS m, np AS gone FROM s JOIN best ON s.w = best.w AND s.p = b % 4294967296),
   pair AS MATERIALIZED (SELECT pick.*, s.np AS gnp, s.nt AS gnt FROM s JOIN pick ON s.w = pick.w AND s.p = gone)
  SELECT k + 1, s.w, p, CASE WHEN p = p0 THEN m ELSE t END, CASE WHEN p = p0 THEN gnp ELSE np END, CASE WHEN p = p0 THEN gnt WHEN np = p0 THEN m ELSE nt END
  FROM s JOIN pair ON s.w = pair.w WHERE p <> gone)
)
SELECT s.w, p, t FROM s JOIN (SELECT w, max(k) AS k FROM s GROUP BY w) f ON f.w = s.w AND f.k = s.k ORDER BY s.w, p
"""
# For long words: only the present row of each place is held, and a step does
# all contractions of the least rank, from the left, up to the first that makes
# a pair of lower rank. Those are the ones that steps of one contraction each
# would do, in that order, since until then nothing of lower rank is there.
_MERGE_ORDERED = """
WITH RECURSIVE s(w, p, t, np, nt, m) USING KEY (w, p) AS (
  SELECT w, p, t, np, nt, m FROM start LEFT JOIN merges ON lr = t::BIGINT * 4294967296 + nt
  UNION
  (WITH best AS MATERIALIZED (SELECT w, min(m) AS b FROM recurring.s WHERE m IS NOT NULL GROUP BY w),
   equal AS (SELECT s.w, p, np, m, lag(np) OVER (PARTITION BY s.w ORDER BY p) AS before FROM recurring.s AS s JOIN best ON s.w = best.w AND m = b),
   runs AS (SELECT *, sum(CASE WHEN before = p THEN 0 ELSE 1 END) OVER (PARTITION BY w ORDER BY p) AS run FROM equal),
   apart AS MATERIALIZED (SELECT w, p AS p0, np AS gone, m FROM (SELECT *, row_number() OVER (PARTITION BY w, run ORDER BY p) AS i FROM runs) WHERE i % 2 = 1),
   after AS MATERIALIZED (SELECT apart.*, s.np AS gnp, s.nt AS gnt FROM recurring.s AS s JOIN apart ON s.w = apart.w AND s.p = gone),
   ahead AS MATERIALIZED (SELECT x.w, x.p, p0, m AS nt, x.np, CASE WHEN g.gone IS NULL THEN x.t ELSE m END AS t, g.gone IS NOT NULL AS joined
     FROM (SELECT s.w, s.p, s.t, s.np, p0, apart.m FROM recurring.s AS s JOIN apart ON s.w = apart.w AND s.np = p0 WHERE s.t >= 0) x LEFT JOIN (SELECT w, gone FROM apart) g ON g.w = x.w AND g.gone = x.p),
   halt AS (SELECT w, min(p0) AS last FROM (SELECT w, p0, m AS r, m AS t, gnt AS nt FROM after UNION ALL SELECT w, p0, nt, t, nt FROM ahead) x JOIN merges ON lr = t::BIGINT * 4294967296 + nt WHERE merges.m < r GROUP BY w),
   pair AS MATERIALIZED (SELECT after.* FROM after LEFT JOIN halt ON halt.w = after.w WHERE last IS NULL OR p0 <= last),
   new AS MATERIALIZED (
     SELECT a.w, a.p0 AS p, a.m AS t, a.gnp AS np, CASE WHEN b.p0 IS NULL THEN a.gnt ELSE b.m END AS nt FROM pair a LEFT JOIN pair b ON b.w = a.w AND b.p0 = a.gnp
     UNION ALL SELECT ahead.w, ahead.p, ahead.t, ahead.np, ahead.nt FROM ahead JOIN pair ON pair.w = ahead.w AND pair.p0 = ahead.p0 WHERE NOT joined)
  SELECT w, p, t, np, nt, merges.m FROM new LEFT JOIN merges ON lr = t::BIGINT * 4294967296 + nt
  UNION ALL SELECT w, gone, -1, -1, -1, NULL FROM pair)
)
SELECT w, p, t FROM s WHERE t >= 0 ORDER BY w, p
"""
_DECODE = "SELECT w, unhex(array_to_string(list(hx ORDER BY p), '')) AS b FROM tokens JOIN vocab ON t = id GROUP BY w"


def read_ranks(rank_file: str) -> dict[bytes, int]:
    """Tokens and ranks of a file with a base64 token and a rank a line."""
    with open(rank_file, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class _Numbered(dict):
    """Numbers keys from 0 as they are first looked up."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


class Coder:
    """One DuckDB connection with the vocabulary and, for encoding, all pairs of tokens whose bytes make a token."""

    def __init__(self, rank_file: str, pattern: str, encodes: bool = True, memory: str = "250MB") -> None:
        import duckdb
        import regex

        self.ranks = read_ranks(rank_file)
        self.pattern = regex.compile(pattern)
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.spill = tempfile.TemporaryDirectory()
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": self.spill.name})
        self._table("vocab", id=np.array(list(self.ranks.values()), np.int32), hx=[t.hex() for t in self.ranks])
        if not encodes:
            return
        self._forget()
        # Bytes of all tokens in one array, by id, to check what comes out of a merge.
        by_id = {r: t for t, r in self.ranks.items()}
        lengths = np.array([len(by_id.get(i, b"")) for i in range(max(by_id) + 1)])
        self.bytes, self.ends = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(len(lengths))), np.uint8), np.cumsum(lengths)
        pairs = [(a, b, r) for t, r in self.ranks.items() for i in range(1, len(t)) if (a := self.ranks.get(t[:i])) is not None and (b := self.ranks.get(t[i:])) is not None]
        left, right, merged = (np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 3
        self._table("merges", lr=left * (1 << 32) + right, m=merged.astype(np.int32))

    def _table(self, table: str, **columns: object) -> None:
        self.db.register("incoming", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {table} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def close(self) -> None:
        self.db.close()
        self.spill.cleanup()

    def decode(self, tokens: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The bytes of runs of tokens that end at ``ends``."""
        lengths = np.diff(ends, prepend=0)
        words = np.repeat(np.arange(len(ends), dtype=np.int32), lengths)
        self._table("tokens", w=words, p=(np.arange(len(tokens)) - np.repeat(ends - lengths, lengths)).astype(np.int32), t=tokens)
        out = [b""] * len(ends)
        for w, b in self.db.execute(_DECODE).fetchall():
            out[w] = b
        return out

    def _spells(self, tokens: np.ndarray, data: np.ndarray) -> bool:
        """Whether the tokens' bytes are ``data``."""
        begins = np.concatenate([[0], self.ends[:-1]])[tokens]
        n = self.ends[tokens] - begins
        return int(n.sum()) == len(data) and bool(np.array_equal(self.bytes[np.repeat(begins - (np.cumsum(n) - n), n) + np.arange(len(data))], data))

    def _contracted(self, words: list[bytes], query: str) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, number of tokens of each word) by one of the merge queries."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        lengths = np.array([len(w) for w in words])
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        place = (np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
        token = self.byte[data]
        last = np.append(word[1:] != word[:-1], True)
        self._table("start", w=word, p=place, t=token, np=np.where(last, np.int32(-1), place + np.int32(1)), nt=np.where(last, np.int32(-1), np.roll(token, -1)))
        got = self.db.execute(query).fetchnumpy()
        tokens = np.asarray(got["t"], np.int32)
        if not self._spells(tokens, data):
            raise RuntimeError("the merged tokens don't give their words back")
        return tokens, np.bincount(np.asarray(got["w"]), minlength=len(words))

    def _merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, ends) of words that aren't tokens themselves."""
        is_long = np.array([len(w) > LONG for w in words], bool)
        counts = np.zeros(len(words), np.int64)
        parts = []
        for at, query in ((np.flatnonzero(~is_long), _MERGE), (np.flatnonzero(is_long), _MERGE_ORDERED)):
            tokens, counts[at] = self._contracted([words[i] for i in at], query)
            parts.append((at, tokens))
        ends = np.cumsum(counts)
        out = np.zeros(counts.sum(), np.int32)
        for at, tokens in parts:
            n = counts[at]
            out[np.repeat(ends[at] - n - (np.cumsum(n) - n), n) + np.arange(n.sum())] = tokens
        return out, ends

    def _forget(self) -> None:
        self.known = _Numbered()
        self.tokens, self.first, self.length = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, words: list[bytes]) -> None:
        """Add the tokens of new words, which have the next numbers."""
        whole = np.array([self.ranks.get(w, -1) for w in words], np.int32)
        rest = np.flatnonzero(whole < 0)
        merged, ends = self._merged([words[i] for i in rest])
        # Merged words' tokens come first, then one token each of the others.
        length = np.ones(len(words), np.int64)
        first = np.arange(len(words)) + len(merged)
        length[rest] = np.diff(ends, prepend=0)
        first[rest] = ends - length[rest]
        self.first = np.concatenate([self.first, first + len(self.tokens)])
        self.length = np.concatenate([self.length, length])
        self.tokens = np.concatenate([self.tokens, merged, whole])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, ends) of whole texts, without special tokens."""
        if len(self.known) > REMEMBERED:
            self._forget()
        before = len(self.known)
        each = [np.array(list(map(self.known.__getitem__, self.pattern.findall(t))), np.int64) for t in texts]
        self._learn([w.encode() for w in islice(self.known, before, None)])
        every = np.concatenate(each) if each else np.zeros(0, np.int64)
        n = self.length[every]
        at = np.repeat(self.first[every] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.tokens[at], np.cumsum(np.array([self.length[e].sum() for e in each], np.int64))


def _blocks(sizes: list[int], limit: int) -> Iterator[slice]:
    first = total = 0
    for i, n in enumerate(sizes):
        if i > first and total + n > limit:
            yield slice(first, i)
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield slice(first, len(sizes))


def _mapped(df: DataFrame, column: str, outs: list[str], work, rank_file: str, pattern: str, encodes: bool) -> DataFrame:
    """``df`` with the binary columns ``outs``, which ``work`` makes of ``column``, in its place."""
    keep = [c for c in df.columns if c != column and c not in outs]
    schema = df.select(*keep, *[F.lit(b"").alias(c) for c in outs]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(rank_file, pattern, encodes)
        try:
            for batch in batches:
                sizes = pa.compute.binary_length(batch.column(column)).to_pylist()
                for part in _blocks(sizes, BLOCK_CHARS):
                    rows = batch.slice(part.start, part.stop - part.start)
                    made = [pa.array(x, pa.binary()) for x in work(coder, rows.column(column))]
                    yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in keep], *made], [*keep, *outs])
        finally:
            coder.close()
            del coder
            release()

    small_batches(df.sparkSession)
    return df.select(*keep, column).mapInArrow(run, schema)


def _packed(tokens: np.ndarray, ends: np.ndarray) -> list[bytes]:
    data, stops = tokens.astype("<u4").tobytes(), [0, *(ends * 4).tolist()]
    return [data[a:b] for a, b in zip(stops, stops[1:], strict=False)]


def _encoded(coder: Coder, texts: pa.Array) -> list[list[bytes]]:
    return [_packed(*coder.encode(texts.to_pylist()))]


def _round_trip(coder: Coder, texts: pa.Array) -> list[list[bytes]]:
    tokens, ends = coder.encode(texts.to_pylist())
    return [_packed(tokens, ends), coder.decode(tokens, ends)]


def _decoded(coder: Coder, ids: pa.Array) -> list[list[bytes]]:
    runs = [np.frombuffer(x, "<u4").astype(np.int32) for x in ids.to_pylist()]
    return [coder.decode(np.concatenate(runs), np.cumsum([len(r) for r in runs])) if runs else []]


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", ids: str = "token_ids", decoded: str | None = None) -> DataFrame:
    """Replace ``text`` by ``ids``: the whole text's token ids as little-endian unsigned 32-bit integers, as in token files.

    With ``decoded``, a column of that name has the bytes that the ids decode
    to. Null texts count as empty and give no bytes. Repeated rows are encoded
    alike; other columns stay, but those called like the new ones are replaced.
    An empty table gives no rows. A text of any length is encoded whole. A
    pre-token of very great length holds a row a byte and takes a step for each
    change of its least rank: 100,000 random letters without a blank take about
    100 seconds, 100,000 equal ones one second.
    """
    docs = docs.withColumn(text, whole_text(text))
    if decoded is None:
        return _mapped(docs, text, [ids], _encoded, rank_file, pattern, True)
    return _mapped(docs, text, [ids, decoded], _round_trip, rank_file, pattern, True)


def decode_documents(docs: DataFrame, rank_file: str, pattern: str, ids: str = "token_ids", data: str = "decoded") -> DataFrame:
    """Replace ``ids`` by ``data``, the decoded bytes; null ids count as none."""
    return _mapped(docs.withColumn(ids, F.coalesce(F.col(ids), F.lit(b""))), ids, [data], _decoded, rank_file, pattern, False)
