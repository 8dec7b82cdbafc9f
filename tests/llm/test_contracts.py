"""Queries without SQL against brute force, over a whole small table."""

import hashlib
import math
import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from plumbline.llm import bpe, chat_format, importance, queries, secret_scan
from plumbline.llm.common import table, whole_text
from tests.llm.helpers import words
from tests.llm.test_free import brute_passages, vocabulary  # noqa: F401
from tests.llm.test_native import brute_base, brute_battery
from tests.test_queries import DATA

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def texts():
    rows = pq.read_table(f"{DATA}/documents.parquet").to_pylist()
    return [(r["doc_id"], r["text"] or "") for r in rows]


def test_bpe_digests(spark, vocabulary):  # noqa: F811
    library = vocabulary[2]
    want = []
    for i, t in texts():
        ids = library.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = queries.op5_bpe(spark, DATA).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_long_words_equal_the_library(vocabulary):  # noqa: F811
    path, pattern, library = vocabulary
    rnd = random.Random(30)
    some = ["".join(rnd.choice(letters) for _ in range(n)) for letters in ("ab", "the ing".replace(" ", ""), "abcdefghijklmnopqrstuvwxyz", "éàü日本") for n in (39, 40, 41, 42, 200, 1500)] + ["a" * 5001, "ab" * 700, "-" * 333]
    coder = bpe.Coder(path, pattern)
    try:
        tokens, ends = coder.encode(some)
    finally:
        coder.close()
    for t, a, b in zip(some, [0, *ends], ends):
        assert tokens[a:b].tolist() == library.encode_ordinary(t)


def test_importance_of_the_whole_table(spark):
    docs = texts()
    labels = pq.read_table(f"{DATA}/labels.parquet").to_pylist()
    good, wanted = {}, {}
    for r in labels:
        if r["quality"] is not None:
            good[r["doc_id"]] = max(good.get(r["doc_id"], 0), int(r["quality"] == 1))
            wanted[r["doc_id"]] = max(wanted.get(r["doc_id"], 0), int(r["quality"] == 1 and not r["toxic"]))
    share = sum(good.values()) / len(good)
    buckets = [importance._buckets(pa.array([t]))[0] for _, t in docs]
    count = lambda own: np.bincount(np.concatenate(own), minlength=importance.BUCKETS) + 1
    raw, target = count(buckets), count([b for (i, _), b in zip(docs, buckets) if wanted.get(i)])
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    noise = importance.gumbel([F.coalesce(F.col("doc_id"), F.lit(-1).cast("long")), F.xxhash64(whole_text("text"))], 17)
    luck = {r.doc_id: r.g for r in table(spark, DATA, "documents").select("doc_id", noise.alias("g")).collect()}
    rows = {r.doc_id: r for r in queries.op2_importance(spark, DATA).collect()}
    assert len(rows) == len(docs)
    for (i, _), b in zip(docs, buckets):
        assert rows[i].n_grams == len(b)
        assert rows[i].log_weight == pytest.approx(ratio[b].sum(), abs=1e-6)
        if len(b):
            assert rows[i].priority == pytest.approx(ratio[b].sum() + luck[i], abs=1e-6)
    ranks = sorted((math.floor(r.priority * 65536 + 0.5) for r in rows.values() if r.n_grams), reverse=True)
    least = ranks[round(share * len(ranks)) - 1]
    assert {i for i, r in rows.items() if r.kept} == {i for i, r in rows.items() if r.n_grams and math.floor(r.priority * 65536 + 0.5) >= least}


def encoding(value):
    return next((e for e in secret_scan.ENCODINGS if re.search(e[1], value)), None)


def brute_tokens(text):
    out = []
    for run in re.finditer(secret_scan.TOKEN, text):
        if len(run[0]) < secret_scan.LEAST_TOKEN:
            continue
        if encoding(run[0]):
            out.append((run.start(), run.end(), run[0]))
            continue
        own = []
        for pattern in secret_scan.PARTS:
            more = [(m.start() + run.start(), m.end() + run.start(), m[0]) for m in re.finditer(pattern, run[0]) if len(m[0]) >= secret_scan.LEAST_TOKEN and encoding(m[0])]
            own += [m for m in more if not any(a < m[1] and m[0] < b for a, b, _ in own)]
        out += own
    return sorted(out)


def brute_p(value):
    """(encoding, length band, p) with the approximation of the normal tail that the battery uses."""
    name, _, alphabet = encoding(value)
    plain = value.lower() if name == "letters" else value.rstrip("=")
    x, k = [alphabet.index(c) for c in plain], len(alphabet)
    n, mid, df = len(x), (k - 1) / 2, k - 1
    tail = lambda z: 1 / (1 + math.exp(min(1.5976 * z + 0.07056 * z**3, 700)))
    chi = sum(c * c for c in Counter(x).values()) * k / n - n
    ps = [tail(((max(chi, 0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))]
    hi = sum(v > mid for v in x)
    both = 2 * hi * (n - hi)
    var = both * (both - n) / (n * n * (n - 1))
    changes = sum((a > mid) != (b > mid) for a, b in zip(x, x[1:]))
    ps.append(min(1, 2 * tail(abs(changes - both / n) / math.sqrt(var))) if var > 0 else 0)
    lagged = sum((a - mid) * (b - mid) for a, b in zip(x, x[1:])) / ((k * k - 1) / 12)
    ps.append(min(1, 2 * tail(abs(lagged) / math.sqrt(n - 1))))
    return name, min(int(math.log2(n)), secret_scan.MAX_BAND), 1 - (1 - min(ps)) ** 3


def brute_thresholds(judged, max_false=0.05):
    bins = secret_scan.BINS
    counts = {}
    for name, band, p in judged:
        counts.setdefault((name, band), Counter())[min(int(p * bins), bins - 1)] += 1
    out = {}
    for (name, band), own in counts.items():
        whole = sum((c for (e, _), c in counts.items() if e == name), Counter())
        every = sum(counts.values(), Counter())
        n = next((c for c in (own, whole, every) if c.total() >= secret_scan.LEAST_IN_BAND), every)
        random_ones = 2 * sum(v for b, v in n.items() if b >= bins // 2)
        for b in range(bins):
            taken = sum(v for x, v in n.items() if x >= b)
            if taken and (taken - min(taken, random_ones * (1 - b / bins))) / taken <= max_false:
                out[name, band] = b / bins
                break
    return out


def brute_spans(docs):
    tokens = {i: [(*t, brute_p(t[2])) for t in brute_tokens(x)] for i, x in docs}
    least = brute_thresholds([t[3] for own in tokens.values() for t in own])
    kinds, out = ["assign", "access", "hex", "random"], {}
    for i, x in docs:
        base = brute_base(x)
        added = [(a, 3, b) for a, b, _, (name, band, p) in tokens[i] if p >= least.get((name, band), 2) and not any(s < b and a < e for s, _, e in base)]
        out[i] = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(base + added))
    return out


def test_all_secret_spans(spark):
    got = {r.doc_id: r.spans for r in queries.op7_secret_scan(spark, DATA).collect()}
    assert got == brute_spans(texts())


def test_spans_of_every_encoding_and_sparse_bands(spark):
    rnd = random.Random(31)
    key = lambda alphabet, n: "".join(rnd.choice(alphabet) for _ in range(n))
    docs = [(100 * e + j, f"see {key(alphabet, 30)} and x={key(alphabet, 44)}/{key(alphabet, 25)} end") for e, (_, _, alphabet) in enumerate(secret_scan.ENCODINGS[:8]) for j in range(40)]
    docs += [(2000 + j, "abcabcabcabcabcabcabcabc1 " + "Zz9" * 10) for j in range(50)] + [(3000, "one " + key(secret_scan.ENCODINGS[5][2], 300))]
    got = secret_scan.scan_secrets(spark.createDataFrame(docs, "doc_id long, text string"))
    rows = {r.doc_id: r.s for r in got.select("doc_id", secret_scan.span_string(F.sort_array(F.concat("base", "added"))).alias("s")).collect()}
    assert rows == brute_spans(docs)
    assert rows[3000]


def test_battery_of_every_encoding(spark):
    rnd = random.Random(32)
    made = []
    for name, _, alphabet in secret_scan.ENCODINGS:
        for n in (20, 33, 64, 200):
            value = "".join(rnd.choice(alphabet) for _ in range(n))
            if encoding(value) and encoding(value)[0] == name:
                made.append((name, alphabet, value, value + "=" * (name.startswith("base") and name != "base62")))
    assert {name for name, *_ in made} == {e[0] for e in secret_scan.ENCODINGS}
    rows = spark.createDataFrame([(i, m[3]) for i, m in enumerate(made)], "i int, t string").select("i", secret_scan.battery(F.col("t")).alias("b")).collect()
    for r in rows:
        name, alphabet, value, _ = made[r.i]
        assert (r.b.encoding, r.b.n) == (name, len(value))
        for got, want in zip((r.b.chi, r.b.runs, r.b.serial), brute_battery(value, alphabet)):
            assert min(got, 1) == pytest.approx(min(want, 1), abs=1e-3)
        assert r.b.p == pytest.approx(brute_p(made[r.i][3])[2], abs=1e-9)


def test_all_repeated_passages(spark):
    docs = texts()
    got = {r.doc_id: r.repeated_spans for r in queries.op9_substring_dedup(spark, DATA).collect()}
    assert got == {i: ",".join(f"{a}:{b}" for a, b in spans) for i, spans in brute_passages(docs).items()}
    assert any(len(words(t)) >= 20 for _, t in docs)


def test_chats_come_in_several_layouts(spark):
    rows = table(spark, DATA, "conversations").select("conv_id", "turn", "role", "text")
    records = queries.mixed_records(rows).select(chat_format.fingerprint(F.col("record")).alias("f"), chat_format.canonical_turns(F.col("record")).alias("t"))
    assert records.select("f").distinct().count() == 3
    assert records.where(F.col("t").isNull() | (F.size("t") != 1)).count() == 0
