import base64
import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import bpe, components, hamming_search, importance, line_dedup, ngram_join, shingles, substring_dedup
from tests.llm.helpers import make, odd_rows, pairs, prose, words

# --- word and n-gram hashes -------------------------------------------------------


def test_word_hashes_are_one_to_one_with_words():
    rnd = random.Random(1)
    texts = [None, "", "a", " a\x0bb\x0c", "é 日本 😀\n", "", *[" ".join(rnd.choice(["a", "b", "ab", "ba", "é", "aa"]) for _ in range(rnd.randrange(9))) for _ in range(60)], "no-space", "x"]
    for array in (pa.array(texts, pa.string()), pa.array(["pad", *texts], pa.string()).slice(1)):
        hashes, counts = shingles.word_hashes(array)
        flat = [w for t in texts for w in words(t)]
        assert len(hashes) == len(flat) == counts[-1]
        assert np.diff(counts).tolist() == [len(words(t)) for t in texts]
        by = defaultdict(set)
        for w, h in zip(flat, hashes.tolist()):
            by[w].add(h)
        assert all(len(v) == 1 for v in by.values())
        assert len({h for v in by.values() for h in v}) == len(by)
        grams, ends = shingles.gram_hashes(hashes, counts, 3)
        real = [tuple(words(t)[i : i + 3]) for t in texts for i in range(len(words(t)) - 2)]
        assert len(set(zip(real, grams.tolist()))) == len(set(real)) == len(set(grams.tolist()))
        unique, at = shingles.unique_grams(grams, ends)
        assert np.diff(at).tolist() == [len({tuple(words(t)[i : i + 3]) for i in range(len(words(t)) - 2)}) for t in texts]


# --- n-gram join ------------------------------------------------------------------


def grams(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute_join(docs, similarity=0.8):
    """(doc_id, class, links, copies) a row, over all pairs."""
    links = defaultdict(set)
    for a, b in itertools.combinations(range(len(docs)), 2):
        x, y = docs[a][1] or "", docs[b][1] or ""
        if not words(x) or not words(y):
            continue
        p, q = grams(x), grams(y)
        if x == y or (p and q and len(p & q) >= similarity * len(p | q)):
            links[a].add(b)
            links[b].add(a)
    out = []
    for a in range(len(docs)):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        ids = [docs[i][0] for i in seen if docs[i][0] is not None]
        own = 1 if not words(docs[a][1]) else sum(d[1] == docs[a][1] for d in docs)
        out.append((docs[a][0], (min(ids) if ids else None) if words(docs[a][1]) else docs[a][0], len(links[a]), own))
    return out


def edited(rnd, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rnd.randrange(len(w))] = f"new{rnd.randrange(10**6)}"
    return " ".join(w)


def near_copies(rnd, groups, size):
    docs = []
    for _ in range(groups):
        base = prose(rnd, rnd.randrange(80, 200), 5000)
        docs += [base, base] + [edited(rnd, base, rnd.randrange(1, 5)) for _ in range(size)]
    docs += [prose(rnd, rnd.randrange(1, 120), 5000) for _ in range(60)]
    rnd.shuffle(docs)
    return list(enumerate(docs))


def test_join_equals_all_pairs(spark):
    docs = near_copies(random.Random(2), 12, 4)
    got = ngram_join.ngram_join(make(spark, docs)).select("doc_id", "class_id", "n_links", "n_copies").collect()
    assert pairs(got) == pairs(brute_join(docs))


def test_join_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_TEXTS", 7)
    docs = near_copies(random.Random(3), 2, 40)
    got = ngram_join.ngram_join(make(spark, docs)).select("doc_id", "class_id", "n_links", "n_copies").collect()
    assert pairs(got) == pairs(brute_join(docs))


def test_join_of_odd_rows(spark):
    docs = odd_rows(random.Random(4))
    got = ngram_join.ngram_join(make(spark, docs, clash=True)).select("doc_id", "class_id", "n_links", "n_copies").collect()
    assert pairs(got) == pairs(brute_join(docs))
    assert ngram_join.ngram_join(make(spark, [])).collect() == []


def test_bands_reach_recall():
    for similarity, recall in ((0.8, 0.9999), (0.9, 0.99), (0.5, 0.999)):
        b = ngram_join.choose_bands(similarity, recall)
        assert 1 - (1 - similarity**5) ** b >= recall > 1 - (1 - similarity**5) ** (b - 1)


def test_keep_one(spark):
    docs = odd_rows(random.Random(5)) + [(100 + i, t) for i, t in near_copies(random.Random(6), 5, 3)]
    kept = ngram_join.keep_one(make(spark, docs, clash=True))
    assert kept.columns == make(spark, docs, clash=True).columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    brute = brute_join(docs)
    classes = {c if c is not None else d[1] for d, (_, c, _, _) in zip(docs, brute) if words(d[1])}
    assert len([r for r in rows if words(r[1])]) == len(classes)
    assert {r[0] for r in rows if words(r[1])} == classes
    assert sorted(str(r[0]) for r in rows if not words(r[1])) == sorted(str(d[0]) for d in docs if not words(d[1]))


def test_components(spark):
    rnd = random.Random(7)
    edges = [(f"n{rnd.randrange(150)}", f"n{rnd.randrange(150)}") for _ in range(110)] + [(f"c{i:04}", f"c{i + 1:04}") for i in range(60)] + [("s", f"t{i}") for i in range(50)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {k: v for k, v in root.items() if k != v}


# --- importance -------------------------------------------------------------------


def classified(rnd, n):
    good = lambda: prose(rnd, rnd.randrange(30, 200), 300)
    junk = lambda: " ".join(f"junk{rnd.randrange(300)}" for _ in range(rnd.randrange(30, 200)))
    return [(i, good() if i % 4 else junk()) for i in range(n)]


def test_held_out_accuracy(spark):
    docs = classified(random.Random(8), 400)
    df = make(spark, docs, clash=True)
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(100)], "doc_id long, quality int, toxic int")
    target, share = importance.labelled_target(df, labels)
    assert share == 0.75
    rows = importance.resample(df, target, share).collect()
    assert sum(r.kept for r in rows) == 300
    held_out = [r for r in rows if r.doc_id >= 100]
    assert sum(r.kept == (r.doc_id % 4 > 0) for r in held_out) >= 0.97 * len(held_out)
    again = importance.resample(df.repartition(5), target, share, keep_rows=True)
    assert [c for c in again.columns if c not in ("n_grams", "log_weight", "priority", "kept")] == [c for c in df.columns if c not in ("n_grams", "log_weight", "priority", "kept")]
    assert {r.doc_id for r in again.where("kept").collect()} == {r.doc_id for r in rows if r.kept}


def test_weights_are_log_ratios_of_the_counts(spark):
    docs = [(1, "a b a"), (2, "c"), (3, "b c d"), (4, None)]
    target = make(spark, [(9, "a b")]).select("text")
    rows = {r.doc_id: r for r in importance.resample(make(spark, docs), target, 0.5).collect()}

    def buckets(t):
        return importance._buckets(pa.array([t]))[0].tolist()

    t, raw = Counter(buckets("a b")), Counter(b for _, x in docs for b in buckets(x))
    ratio = lambda b: np.log((t[b] + 1) / (t.total() + importance.BUCKETS)) - np.log((raw[b] + 1) / (raw.total() + importance.BUCKETS))
    for i, x in docs:
        assert rows[i].log_weight == pytest.approx(sum(map(ratio, buckets(x))))
        assert rows[i].n_grams == len(buckets(x)) == max(0, 2 * len(words(x)) - 1)


@pytest.mark.parametrize("k", [1, 7, 500, 999, 1000, 1001, 0])
def test_top_k_threshold(spark, k):
    rnd = random.Random(9)
    values = [rnd.choice([rnd.randrange(-5, 5), rnd.randrange(-(2**62), 2**62)]) for _ in range(1000)]
    got = importance.top_k_threshold(spark.createDataFrame([(v,) for v in values], "v long"), "v", k)
    assert got == (sorted(values, reverse=True)[k - 1] if 0 < k <= 1000 else None)


def test_importance_of_odd_rows(spark):
    docs = odd_rows(random.Random(10))
    df = make(spark, docs, clash=True)
    target = df.where("doc_id = 4").select("text")
    rows = importance.resample(df, target, 0.5).collect()
    assert Counter(r.doc_id for r in rows) == Counter(d[0] for d in docs)
    assert not any(r.kept for r in rows if r.n_grams == 0)
    assert len({r.kept for r in rows if r.doc_id == 4}) == 1
    assert importance.resample(make(spark, []), target, 0.5).collect() == []
    nothing = importance.resample(df, df.where("false").select("text"), 0.5).collect()
    assert all(r.kept == (r.n_grams > 0) for r in nothing)


# --- Hamming search -----------------------------------------------------------------


def brute_search(rows, queries, k):
    code = {i: [x is not None and x > 0 for x in v] for i, v in rows if v}
    out = []
    for q, v in queries:
        if not v:
            continue
        mine = [x is not None and x > 0 for x in v]
        near = sorted(((sum(a != b for a, b in zip(mine, c)), i is None, i) for i, c in code.items()), key=lambda t: (t[0], t[1], t[2] or 0))
        out += [(q, n + 1, i, d) for n, (d, _, i) in enumerate(near[:k])]
    return out


@pytest.mark.parametrize("dims,n", [(64, 400), (16, 200), (100, 150), (64, 5)])
def test_search_is_exact(spark, dims, n):
    rnd = random.Random(dims + n)
    centres = [[rnd.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    rows = [(i, [c + rnd.gauss(0, 0.6) for c in rnd.choice(centres)]) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(25)]
    queries = rows[:: max(1, n // 12)]
    schema = "vec_id long, embedding array<float>"
    got = hamming_search.search(spark.createDataFrame(rows, schema), spark.createDataFrame(queries, schema), 10).collect()
    assert sorted(map(tuple, got)) == sorted(brute_search(rows, queries, 10))


def test_search_of_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, label int, code string, kth string, distance string"
    rows = [(1, [1.0, -1.0]), (2, None), (3, []), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (6, [1.0, -1.0]), (6, [1.0, -1.0])]
    df = spark.createDataFrame([(i, v, 0, "", "", "") for i, v in rows], schema)
    got = hamming_search.search(df, df.where("vec_id in (1, 2, 3)"), 10).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])][:3] == [1, 6, 6]
    assert {r.query_id for r in got} == {1}
    assert len(got) == 6
    none = df.where("false")
    assert hamming_search.search(none, none).collect() == []
    assert hamming_search.search(df, none).collect() == []


# --- byte-level BPE -------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    public = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = public.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, public.PATTERN, tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_equals_the_library(spark, vocabulary):
    path, pattern, library = vocabulary
    rnd = random.Random(11)
    bits = ["the", " ing", "ABC", "é", "😀", "\n", "  ", "'s", "123", "日本語", "<|endoftext|>", "\x1c", " ", "aaaa", "....", "́", " x"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(40))) for _ in range(200)] + [r[1] for r in odd_rows(rnd)] + ["<|endoftext|>", "a" * 3000, "xyzzy" * 300]
    coded = bpe.encode_documents(make(spark, list(enumerate(texts)), clash=True), path, pattern, decoded="decoded")
    again = {r.doc_id: r.back for r in bpe.decode_documents(coded.select("doc_id", "token_ids"), path, pattern, data="back").collect()}
    for r in coded.collect():
        text = texts[r.doc_id] or ""
        assert np.frombuffer(r.token_ids, "<u4").tolist() == library.encode_ordinary(text)
        assert bytes(r.decoded) == bytes(again[r.doc_id]) == text.encode()
    assert bpe.encode_documents(make(spark, []), path, pattern).collect() == []


def test_both_merge_queries_agree(vocabulary):
    path, pattern, library = vocabulary
    coder = bpe.Coder(path, pattern)
    found = [w.encode() for w in coder.pattern.findall(prose(random.Random(12), 300, 10**6) + " " + "thethethe" * 30) if w.encode() not in coder.ranks]
    plain = [t.tolist() for t in coder._merged(found)]
    fast, bpe._MERGE = bpe._MERGE, bpe._MERGE_ORDERED
    try:
        assert [t.tolist() for t in coder._merged(found)] == plain
    finally:
        bpe._MERGE = fast
        coder.close()


# --- line dedup -----------------------------------------------------------------------


def brute_lines(docs, min_sites):
    """Text and removed lines of each row."""
    trim = lambda x: x.strip(" \t\x0b\x0c\r")
    sites, first = defaultdict(set), {}
    rank = lambda d, i: (d[0] is None, d[0] or 0, d[1] or "", i)
    for d in docs:
        for i, x in enumerate((d[1] or "").split("\n")):
            if x := trim(x):
                sites[x].add(d[3] if len(d) > 3 else "s")
                first[x] = min(first.get(x, rank(d, i)), rank(d, i))
    out = []
    for d in docs:
        lines = (d[1] or "").split("\n")
        gone = {i for i, x in enumerate(lines) if trim(x) and len(sites[trim(x)]) >= min_sites and rank(d, i) != first[trim(x)]}
        out.append((d[0], d[1] if not gone else "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)))
    return out


def test_line_dedup(spark):
    rnd = random.Random(13)
    shared = [f"shared line {i}" for i in range(12)]
    docs = []
    for i in range(150):
        lines = [rnd.choice(shared[: rnd.randrange(1, 13)]) + rnd.choice(["", " ", "\t"]) if rnd.random() < 0.3 else prose(rnd, 5, 10**6) for _ in range(rnd.randrange(1, 9))]
        docs.append((i, "\n".join(lines + [""] * rnd.randrange(2)), "en", f"site{rnd.randrange(2 + i % 11)}"))
    for least in (2, 6, 10):
        got = line_dedup.dedup_lines(make(spark, docs), min_sites=least).select("doc_id", "text", "n_removed").collect()
        assert pairs(got) == pairs(brute_lines(docs, least))


def test_line_dedup_of_odd_rows(spark):
    docs = [(*r, "en", "s")[:4] if len(r) < 4 else r for r in odd_rows(random.Random(14))]
    docs += [(50 + i, "same line\nown line %d" % i, "en", s) for i, s in enumerate(["a", "b", None, "", "a"])]
    df = make(spark, docs, clash=True)
    out = line_dedup.dedup_lines(df, min_sites=3)
    assert pairs(out.select("doc_id", "text", "n_removed").collect()) == pairs(brute_lines(docs, 3))
    assert [c for c in out.columns if c not in ("n_lines", "n_removed")] == [c for c in df.columns if c != "n_removed"]
    assert line_dedup.dedup_lines(make(spark, [])).collect() == []


def test_estimates_above_the_margin_need_no_exact_count(spark):
    lines = [(1, 1, f"s{i % 5000}", i) for i in range(9000)] + [(2, 2, f"s{i}", i) for i in range(99)] + [(3, 3, f"s{i % 100}", i) for i in range(500)]
    df = spark.createDataFrame(lines, "h1 long, h2 long, site string, at long")
    assert {r.h1 for r in line_dedup.spread_lines(df, 100).collect()} == {1, 3}


# --- substring dedup ------------------------------------------------------------------


def test_chunks_follow_each_other_and_resist_shifts():
    rnd = random.Random(15)
    text = prose(rnd, 3000, 10**6)
    shifted = "inserted é words " + text[:5000] + " more " + text[5000:]
    odd = [None, "", "é" * 500, "x " * 1000, "short"]
    seen, among = substring_dedup.chunk_words(20)
    row, place, size, digest = substring_dedup.chunks(pa.array([text, shifted, *odd]), 20)
    for r, t in enumerate([text, shifted, *odd]):
        own, n = row == r, len(words(t))
        if n < 20:
            assert not own.any()
            continue
        assert place[own][0] < among and place[own][-1] + size[own][-1] > n - among
        assert (place[own][1:] == (place + size)[own][:-1] - seen).all()
        assert size[own].min() > seen and size[own].max() <= seen + among
    digests = lambda r: set(digest[row == r].tolist())
    assert len(digests(0) & digests(1)) > 0.95 * len(digests(0))
    assert substring_dedup.chunks(pa.array([text]), 20)[3].tolist() == digest[row == 0].tolist()


@pytest.mark.parametrize("n", [2, 3, 5, 9, 20, 31])
def test_passages_hold_a_chunk_wherever_they_stand(n):
    rnd = random.Random(16)
    for letters in ("ab", "abcdefgh", "a"):
        short = lambda m: [rnd.choice(letters) for _ in range(m)]
        passage = short(n)
        found = []
        for _ in range(40):
            before = short(rnd.randrange(40))
            _, place, size, digest = substring_dedup.chunks(pa.array([" ".join([*before, *passage, *short(rnd.randrange(40))])]), n)
            inside = (place >= len(before)) & (place + size <= len(before) + n)
            found.append(set(zip((place - len(before))[inside].tolist(), size[inside].tolist(), digest[inside].tolist())))
        assert set.intersection(*found)


def test_gear_hash_equals_its_definition():
    data = np.random.default_rng(16).integers(0, 2**64, 500, dtype=np.uint64)
    for seen in (1, 2, 4, 6):
        rolled, h = substring_dedup.gear_hashes(data, seen), 0
        for i, w in enumerate(data.tolist()):
            h = ((h << -(-64 // seen)) + w) % 2**64
            assert int(rolled[i]) == int(shingles.mix(np.array([h], np.uint64))[0])


def test_repeated_passages(spark):
    rnd = random.Random(17)
    passages = [prose(rnd, 60, 10**6) for _ in range(8)]
    docs, holders = [], defaultdict(list)
    for i in range(60):
        text = [prose(rnd, rnd.randrange(20, 100), 10**6)]
        if i % 3 == 0:
            p = rnd.randrange(8)
            holders[p].append(i)
            text += [passages[p], prose(rnd, rnd.randrange(20, 100), 10**6)]
        docs.append((i, " ".join(text)))
    rows = {r.doc_id: r for r in substring_dedup.repeated_passages(make(spark, docs, clash=True)).collect()}
    assert set(rows) == {i for own in holders.values() if len(own) > 1 for i in own}
    for p, own in holders.items():
        for i in own if len(own) > 1 else []:
            found = " ".join(docs[i][1][s.start : s.end] for s in rows[i].repeated)
            assert found in docs[i][1]
            assert len(words(found)) > 20
            assert len(set(words(found)) & set(words(passages[p]))) >= len(words(found)) - 2
            assert bool(rows[i].removable) == (i != min(own))
    cleaned = {r.doc_id: r.text for r in substring_dedup.remove_passages(make(spark, docs)).collect()}
    for i, t in docs:
        gone = rows[i].removable if i in rows else []
        assert len(cleaned[i]) == len(t) - sum(s.end - s.start for s in gone)
        if not gone:
            assert cleaned[i] == t


def test_substrings_of_odd_rows(spark):
    docs = odd_rows(random.Random(18))
    rows = substring_dedup.repeated_passages(make(spark, docs, clash=True)).collect()
    assert {r.doc_id for r in rows} == {4, 5, None}
    assert {r.doc_id: len(r.removable) for r in rows} == {4: 0, 5: 1, None: 1}
    assert substring_dedup.repeated_passages(make(spark, [])).collect() == []
    out = substring_dedup.remove_passages(make(spark, docs, clash=True))
    assert out.count() == len(docs)
    assert {r.text for r in out.where("doc_id = 4").collect()} == {docs[3][1]}
    assert {r.text for r in out.where("doc_id = 5").collect()} == {""}


def brute_passages(docs, n=20):
    """Spans that repeated windows of n words cover, by document."""
    at = defaultdict(set)
    spans = {i: [m.span() for m in re.finditer(r"[^ \t-\r]+", t)] for i, t in docs}
    for i, t in docs:
        for j in range(len(spans[i]) - n + 1):
            at[tuple(words(t)[j : j + n])].add((i, j))
    out = defaultdict(list)
    for i, j in sorted(p for own in at.values() if len(own) > 1 for p in own):
        a, b = spans[i][j][0], spans[i][j + n - 1][1]
        if out[i] and out[i][-1][1] >= a:
            out[i][-1] = (out[i][-1][0], b)
        else:
            out[i].append((a, b))
    return dict(out)


def test_passages_are_whole_and_exact(spark):
    rnd = random.Random(19)
    short = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 5))) for _ in range(n))
    docs = []
    for i in range(150):
        passage = short((20, 51)[i % 2])
        docs += [(2 * i + j, f"{short(rnd.randrange(70))} é {passage} {short(rnd.randrange(70))}") for j in range(2)]
    docs += [(400, "x " + "la " * 60 + "y"), (401, "la di " * 40), (402, short(19) + " q"), (403, "never twice " + short(30))]
    docs.append((404, docs[-2][1][:-2] + " z"))
    rows = {r.doc_id: r for r in substring_dedup.repeated_passages(make(spark, docs)).collect()}
    want = brute_passages(docs)
    assert {i: [tuple(s) for s in r.repeated] for i, r in rows.items()} == want
    assert all(bool(rows[i].removable) == (i % 2 == 1) for i in range(300))
    cleaned = [(r.doc_id, r.text) for r in substring_dedup.remove_passages(make(spark, docs)).collect()]
    windows = lambda rows: {tuple(words(t)[j : j + 20]) for _, t in rows for j in range(len(words(t)) - 19)}
    repeated = {w for i, t in docs for a, b in want.get(i, []) for w in windows([(i, t[a:b])])}
    assert repeated <= windows(cleaned)
    assert brute_passages(cleaned) == {}


def test_copies_and_their_passages(spark):
    rnd = random.Random(20)
    passage, lone = prose(rnd, 40, 10**6), [prose(rnd, 90, 10**6) for _ in range(3)]
    copied = f"{lone[0]} {passage} é {lone[1]}"
    docs = [(3, copied), (5, copied), (5, copied), (9, copied), (1, f"{passage} {prose(rnd, 30, 10**6)}"), (7, f"x {lone[1]}"), (8, lone[2]), (2, lone[2]), (6, prose(rnd, 19) + "\n"), (4, prose(rnd, 19))]
    rows = {r.doc_id: r for r in substring_dedup.repeated_passages(make(spark, docs)).collect()}
    assert {i: [tuple(s) for s in r.repeated] for i, r in rows.items()} == brute_passages(sorted(docs))
    assert {i: len(r.removable) for i, r in rows.items()} == {1: 0, 2: 0, 3: 1, 5: 1, 7: 1, 8: 1, 9: 1}
    # Windows over the passage's ends are first here and keep 19 words of it on each side.
    begin, of = copied.index(passage), words(passage)
    assert tuple(rows[3].removable[0]) == (begin + len(" ".join(of[:19])) + 1, begin + len(" ".join(of[:21])) + 1)
    assert all(rows[i].removable == rows[i].repeated for i in (5, 7, 8, 9))
