import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from plumbline.llm import line_dedup, ngram_join
from plumbline.llm.oracles import oracle_sql
from tests.llm.helpers import make, odd_rows, pairs, prose, words
from tests.llm.test_free import brute_join, brute_lines, edited
from tests.llm.test_native import brute_targets
from tests.test_queries import DATA, db  # noqa: F401

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
QUERIES = [name for name in entry.queries() if name.startswith("op")]


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, db, name):  # noqa: F811
    got = entry.queries()[name](spark, DATA)
    result = db.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(got.columns)
    key = lambda row: tuple((v is None, str(v)) for v in row)
    assert sorted(key(r[c] for c in columns) for r in got.collect()) == sorted(map(key, result.fetchall()))


def test_there_is_a_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert "pipeline" in entry.queries()


@pytest.fixture
def corpus(spark, tmp_path):
    """A folder with documents and labels that the stages can be held against."""
    rnd = random.Random(20)
    docs = []
    for i in range(160):
        text = prose(rnd, rnd.randrange(40, 160), 5000) if i % 5 else " ".join(f"#junk{rnd.randrange(200)}$" for _ in range(80))
        docs.append((i, text + "\nAll rights reserved by nobody\nown end", "en", f"site{i % 9}"))
    docs += [(200 + i, docs[i + 1][1], "en", "site1") for i in range(0, 20, 5)]
    docs += [(300 + i, edited(rnd, docs[i + 1][1], 2), "en", "site2") for i in range(0, 20, 5)]
    docs += odd_rows(rnd)
    make(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(i % 5 > 0), 0) for i in range(100)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path), docs


def test_stages(spark, corpus, tmp_path):
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        rows = docs.collect()
        if name != "bpe":
            assert docs.columns == columns
            assert all(r.n_chars == len(r.text or "") for r in rows)
        if name == "quality_classifier":
            kept = {r.doc_id for r in rows}
            assert len([i for i in range(160) if i % 5 and i not in kept]) <= 3
            assert len([i for i in range(0, 160, 5) if i in kept]) <= 3
        elif name == "line_dedup":
            want = [(i, t) for i, t, _ in brute_lines(before, 6)]
            emptied = [b for (b, t) in zip(before, want) if words(b[1]) and not words(t[1])]
            assert pairs((r.doc_id, r.text) for r in rows) == pairs(w for w, b in zip(want, before) if b not in emptied)
        elif name == "ngram_join":
            classes = {c if c is not None else b[1] for b, (_, c, _, _) in zip(before, brute_join([b[:2] for b in before])) if words(b[1])}
            assert sorted(r.doc_id for r in rows if words(r.text)) == sorted(classes)
        elif name == "mixing":
            sizes = Counter()
            for _, t, _, s in before:
                sizes[s] += len(words(t))
            got = Counter()
            for r in rows:
                got[r.source] += len(words(r.text))
            for s, target in brute_targets(sizes).items():
                longest = max((len(words(t)) for _, t, _, x in before if x == s), default=0)
                assert abs(got[s] - target) <= longest + 2
            assert max(Counter((r.doc_id, r.text, r.source) for r in rows).values()) <= 2
            assert {(r.doc_id, r.text) for r in rows} <= {b[:2] for b in before}
        else:
            assert len(rows) == len(before)
            assert all(r.round_trip for r in rows)
            assert sum(r.n_tokens for r in rows) * 4 == sum(len(r.token_ids) for r in rows)


def test_mixing_stage_keeps_sources_below_a_block(spark):
    rnd = random.Random(22)
    docs = [(i, prose(rnd, 2000), "en", f"s{i % 3}") for i in range(300)] + [(900 + i, f"word{i}", "en", f"t{i}") for i in range(4)] + [(990, "alone", "en", None)]
    rows = pipeline.mixing_stage(spark, make(spark, docs), "").where("doc_id >= 900").collect()
    assert Counter(r.doc_id for r in rows) == Counter({i: 2 for i in (900, 901, 902, 903, 990)})


def test_stages_keep_columns_of_any_name(spark, corpus):
    folder, docs = corpus
    df = make(spark, docs, clash=True)
    for name, stage in pipeline.STAGES:
        out = stage(spark, df, folder)
        if name == "bpe":
            assert out.count() == len(docs)
            continue
        plain = stage(spark, make(spark, docs), folder)
        assert out.columns == df.columns
        assert set(r.kept for r in out.select("kept").collect()) == {"clash"}
        assert pairs(out.select(plain.columns).collect()) == pairs(plain.collect())


def test_run_on_little(spark, tmp_path):
    for name, df in (("documents", make(spark, [])), ("labels", spark.createDataFrame([], "doc_id long, quality int, toxic int"))):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    assert pipeline.run(spark, str(tmp_path)).collect() == []


def test_whole_run(spark):
    rows = pipeline.run(spark, DATA).collect()
    assert len(rows) > 100
    assert all(r.round_trip for r in rows)


def test_stage_operators_keep_other_columns(spark):
    df = make(spark, odd_rows(random.Random(21)), clash=True)
    assert line_dedup.dedup_lines(df).drop("n_lines", "n_removed").columns == df.drop("n_removed").columns
    assert ngram_join.keep_one(df).columns == df.columns
    assert df.where(F.col("kept") == "clash").count() == df.count()
