import pytest
from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.functions.stats import distribution, percentile


def one(spark, column, **values):
    names = list(values) or ["x"]
    return spark.createDataFrame([tuple(values.values()) or (0,)], names).select(column.alias("r")).first().r


@pytest.mark.parametrize("x,expected", [(1.005, 1.0), (8.665, 8.66), (-0.005, 0.0), (8.667, 8.67), (-1.5, -1.5), (2.0, 2.0)])
def test_round_half_up_is_of_the_binary_value(spark, x, expected):
    assert one(spark, S.round_half_up("x"), x=x) == expected == S.round_half_up_py(x)


@pytest.mark.parametrize("x,expected", [(7.4499, 7.4), (6.05, 6.1)])
def test_one_decimal_for_storage(spark, x, expected):
    assert one(spark, S.round_half_up("x", 1), x=x) == expected == S.round_half_up_py(x, 1)


@pytest.mark.parametrize("x,expected", [(8.25, "8.3"), (1.45, "1.4"), (10.0, "10.0"), (7.0, "7.0"), (-2.5, "-2.5")])
def test_one_decimal_for_display(x, expected):
    assert S.one_decimal(x) == expected


@pytest.mark.parametrize("good,bad,direction,cases", [
    (50.0, 150.0, "lower-better", {50: 10, 10: 10, 150: 0, 500: 0, 100: 5, 75: 7.5}),
    (5.0, 5.0, "lower-better", {5: 10, 6: 0}),
    (10.0, 0.0, "higher-better", {10: 10, 0: 0, 5: 5, 20: 10, -5: 0}),
    (5.0, 5.0, "higher-better", {5: 10, 4: 0}),
    (150.0, 50.0, "lower-better", {150: 10, 50: 0, 100: 5}),
])
def test_sub_scores(spark, good, bad, direction, cases):
    rows = spark.createDataFrame([(float(v), good, bad, direction) for v in cases], "v double, g double, b double, d string")
    assert [r.s for r in rows.select(S.sub_score("v", "g", "b", "d").alias("s")).collect()] == list(cases.values())


@pytest.mark.parametrize("path,external", [("lib/a.ts", False), ("a/node_modules/z", True), ("node:path", True), ("lodash", True), ("index.ts", True), ("x/node:y", False)])
def test_external(spark, path, external):
    assert one(spark, S.is_external("p"), p=path) is external


def test_languages(spark):
    got = spark.createDataFrame([(x,) for x in ["TSX", "Markdown", "C++", "tsx", "Rust"]], "n string").where(S.is_code_language("n")).collect()
    assert {r.n for r in got} == {"TSX", "C++", "Rust"}


@pytest.mark.parametrize("values,p,expected", [([], 75, 0), ([7], 99, 7), ([4, 1, 3, 2], 75, 3.25), ([1, 2, 3, 4], 50, 2.5), ([10, 20, 30, 40, 50], 75, 40), (list(range(1, 11)), 25, 3.25), (list(range(1, 11)), 90, 9.1)])
def test_percentile(spark, values, p, expected):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    assert df.agg(percentile("x", p).alias("r")).first().r == pytest.approx(expected)


def test_distribution(spark):
    df = spark.createDataFrame([(2.0,), (4.0,), (6.0,)], "x double")
    assert df.agg(*distribution("x")).first().asDict() | {} == pytest.approx({"count": 3, "sum": 12, "mean": 4, "min": 2, "max": 6, "p25": 3, "p50": 4, "p75": 5, "p90": 5.6, "p95": 5.8, "p99": 5.96})
    assert set(df.where(F.lit(False)).agg(*distribution("x")).first()) == {0}
