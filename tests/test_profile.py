import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tablelens.operators import profile as P
from tests.conftest import plan_of


def by_name(df):
    return {r.name: r for r in df.collect()}


def test_numeric_column(spark):
    df = spark.createDataFrame([("a", 10.5), ("b", 20.0), ("c", 30.5), ("d", 40.0)], "name string, value double")
    v = by_name(P.profile(df))["value"]
    assert v.is_numeric and v["count"] == 4
    assert v.mean == 25.25 and v.median == 25.25 and v.min == 10.5 and v.max == 40.0
    assert v.std_dev == pytest.approx(statistics.pstdev([10.5, 20.0, 30.5, 40.0]))


def test_string_column(spark):
    df = spark.createDataFrame([("Alice", "hello"), ("Bob", "world"), ("Carol", "hello")], "name string, value string")
    got = by_name(P.profile(df))
    assert not got["name"].is_numeric and got["name"]["count"] == 3
    assert got["value"].mode == "hello" and got["value"].top_freq_content == ("hello", 2)
    assert got["name"].longest == "Alice" and got["name"].shortest == "Bob"
    assert got["name"].mean is None and got["name"].na_count == 0


def test_moments(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.5,), (9.0,)], "v double")
    v = by_name(P.profile(df))["v"]
    assert v.skewness == pytest.approx(1.0517767, abs=1e-6)
    assert v.kurtosis == pytest.approx(-0.7379850, abs=1e-6)
    assert v.variance == pytest.approx(9.921875)


def test_edge_values(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(None, 5.0), (nan, 5.0), (inf, 5.0), (-inf, 5.0), (0.0, 5.0), (-0.0, 5.0), (3.0, 5.0)], "v double, k double")
    got = by_name(P.profile(df))
    v = got["v"]
    assert (v["count"], v.none_count, v.na_count, v.zero_count, v.non_zero_valid_count) == (7, 1, 2, 2, 1)
    assert (v.mean, v.median, v.min, v.max) == (1.0, 0.0, 0.0, 3.0)
    assert (got["k"].skewness, got["k"].kurtosis, got["k"].variance, got["k"].mode) == (0.0, 0.0, 0.0, "5")


def test_every_numeric_type(spark):
    df = spark.sql("select 7 as i, 8L as l, cast(1.5 as float) as f, 2.25 as d, cast(3 as tinyint) as t union all select 9, 8L, 2.5, 2.25, 5")
    got = by_name(P.profile(df))
    assert all(r.is_numeric for r in got.values())
    assert got["i"].median == 8.0 and got["l"].mode == "8" and got["f"].mean == 2.0 and got["d"].mode == "2.25"
    big = spark.sql("select 9007199254740993L as x")
    assert by_name(P.profile(big))["x"].mode == "9007199254740993"


@pytest.mark.parametrize("full", [True, False])
def test_empty_table_and_null_column(spark, full):
    empty = by_name(P.profile(spark.createDataFrame([], "a double, b string, c boolean"), full))
    assert list(empty) == ["a", "b", "c"] and empty["a"]["count"] == 0 and empty["a"].mean is None
    assert empty["a"].is_numeric and not empty["b"].is_numeric
    nulls = by_name(P.profile(spark.createDataFrame([(None, None)] * 3, "a double, b string"), full))
    assert nulls["a"].na_count == 3 and nulls["a"].none_count == 3 and nulls["a"].mode is None
    assert nulls["b"].none_count == 3 and nulls["b"].word_count is None and not nulls["b"].is_inferred


@pytest.mark.parametrize(
    "values, numeric, na",
    [
        ([str(i) for i in range(9)] + ["word"], True, 1),
        ([str(i) for i in range(8)] + ["a", "b"], False, 0),
        (["1d"] * 5, False, 0),
        (["inf", "1", "2"], False, 0),
        ([" 7 ", "", None, "8"], True, 2),
        (["1e999"], False, 0),
        ([".5", "5.", "+1", "-2e3", " 3 "], True, 0),
        (["", "  "], False, 0),
    ],
)
def test_number_inference(spark, values, numeric, na):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    for full in (True, False):
        s = by_name(P.profile(df, full))["s"]
        assert (s.is_numeric, s.is_inferred, s.na_count) == (numeric, numeric, na)
        assert s.dtype == "string"
    if numeric:
        assert s.mean is not None


def test_ties_take_the_smallest(spark):
    df = spark.createDataFrame([(x, n) for x, n in zip("bbaa", [2.0, 1.0, 1.0, 2.0])], "s string, n double")
    got = by_name(P.profile(df))
    assert got["s"].mode == "a" and got["n"].mode == "1" and got["s"].longest == "a"


def test_top_word_and_words(spark):
    df = spark.createDataFrame([("The cat, the cat!",), ("cat　dog",), ("",), (None,)], "s string")
    s = by_name(P.profile(df))["s"]
    assert s.top_freq_word == "cat" and s.word_count == (6, 0, 6)


@pytest.mark.parametrize(
    "values",
    [
        [1.0],
        [1.0, 2.0],
        [3.0, 1.0, 2.0],
        [0.0] * 5 + [1e300, -1e300],
        [1e9 + i * 1e-6 for i in range(999)] + [1e300],
        [-(2.0**i) for i in range(-500, 500)],
        [5.0] * 700 + [6.0] * 300,
        [1.7e308, -1.7e308, 1.6e308, -1.6e308],
        [5e-324, 0.0, -5e-324, 1e-310],
    ],
)
def test_exact_median(spark, values):
    got = by_name(P.profile(spark.createDataFrame([(v,) for v in values], "v double")))["v"].median
    a = sorted(values)
    n = len(a)
    assert got == a[n // 2] if n % 2 else got == pytest.approx(a[n // 2 - 1] / 2 + a[n // 2] / 2)


def test_exact_median_of_random_columns(spark):
    rng = random.Random(5)
    rows = [(rng.gauss(0, 1), rng.expovariate(1e-6), float(rng.randint(0, 3)), rng.choice([None, rng.random()])) for _ in range(3001)]
    got = by_name(P.profile(spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(7)))
    for i, name in enumerate("abcd"):
        assert got[name].median == statistics.median([r[i] for r in rows if r[i] is not None])


def _median_and_scans(monkeypatch, df):
    scans, counted = [], P._counted
    monkeypatch.setattr(P, "_counted", lambda *a: scans.append({i: s.few for i, s in a[2].items()}) or counted(*a))
    n = df.where("v is not null").count()
    return P.exact_medians(df, {0: F.col("v")}, {0: n}).get(0), scans


@pytest.mark.parametrize(
    "expr",
    [
        "case when id = 0 then 1e300 else 1e9 + id * 1e-6 end",  # near-equal values and one far away
        "case when id % 3 = 0 then 7.0 else id * 1.0 end",  # a third of the rows share a value
        "case when id < 20000 then 1.0 else 2.0 end",  # the middle lies between two values
        "case when id < 19999 then 1.0 else 2.0 + id end",
        "cast(hash(id) as double)",
        "case when id % 2 = 0 then hash(id) / 7.0 end",
        "0.0",
    ],
)
def test_median_by_scans(spark, monkeypatch, expr):
    monkeypatch.setattr(P, "SKETCH", 64)
    monkeypatch.setattr(P, "STEPS", 16)
    monkeypatch.setattr(P, "FEW", 50)
    df = spark.range(0, 40000, 1, 5).select(F.expr(f"cast({expr} as double)").alias("v"))
    got, scans = _median_and_scans(monkeypatch, df)
    assert got == statistics.median([r.v for r in df.collect() if r.v is not None])
    assert len(scans) <= 6


def test_median_when_a_sketch_errs(spark, monkeypatch):
    monkeypatch.setattr(P, "FEW", 20)
    monkeypatch.setattr(P, "_first_cuts", lambda df, values: {i: (90.0, 95.0) for i in values})
    df = spark.range(0, 1001, 1, 3).select(F.col("id").cast("double").alias("v"))
    got, scans = _median_and_scans(monkeypatch, df)
    assert got == 500.0 and len(scans) <= 6


def test_median_leaves_few_values_after_one_count(spark, monkeypatch):
    df = spark.range(0, 200000, 1, 4).select(F.expr("case when id = 0 then 1e300 else 1e9 + id * 1e-6 end").alias("v"))
    got, scans = _median_and_scans(monkeypatch, df)
    assert scans == [{0: False}, {0: True}]
    assert got == statistics.median([1e300] + [1e9 + i * 1e-6 for i in range(1, 200000)])


def test_profile_ignores_partitioning(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    one = by_name(P.profile(o.coalesce(1)))
    many = by_name(P.profile(o.repartition(13)))
    for name in one:
        a, b = one[name].asDict(), many[name].asDict()
        for key in a:
            if isinstance(a[key], float):
                assert math.isclose(a[key], b[key], rel_tol=1e-9, abs_tol=1e-9), (name, key)
            else:
                assert a[key] == b[key], (name, key)


def test_hot_value_is_counted_before_the_shuffle(spark, sf):
    df = spark.range(0, 30000, 1, 6).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("double").alias("v"))
    got = by_name(P.profile(df))["v"]
    assert got.mode == "7"
    plan = plan_of(P.profile(df))
    assert "partial_count" in plan


def test_selected_and_numbered_columns(spark):
    df = spark.createDataFrame([("a", 1, 2.0)], "name string, x int, y double")
    assert [r.name for r in P.profile(df, columns="1:2").collect()] == ["x", "y"]
    assert [r.name for r in P.profile(df, columns="y,name", numbered=True).collect()] == ["0", "1"]
    assert [r.name for r in P.profile(df, columns="1,1", full=False).collect()] == ["x", "x"]


def test_each_file_column_is_read_once(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    plan = plan_of(P.profile(o))
    assert plan.count("FileScan parquet") == 2  # numbers and strings
    assert plan.count("ReusedExchange") >= 2  # counts of numbers and of texts; the median needs none
    quick = plan_of(P.profile(o, full=False, columns="o_totalprice"))
    assert "ReadSchema: struct<o_totalprice:double>" in quick


def test_nested_and_time_columns_are_only_counted(spark):
    df = spark.sql("select array(1) as a, timestamp'2024-01-01' as t, true as b, null as n")
    got = by_name(P.profile(df))
    assert all(not r.is_numeric and r.mode is None and r["count"] == 1 for r in got.values())
    assert got["n"].none_count == 1


def test_string_report(spark):
    rows = [(str(i), "" if i % 2 else "x", "", "word" if i == 0 else str(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    report = by_name(P.string_report(df))
    assert [(n, r.type, r.total, r.non_empty) for n, r in sorted(report.items())] == [
        ("a", "numeric", 10, 10), ("b", "string", 10, 5), ("c", "empty", 10, 0), ("d", "string", 10, 10),
    ]
    summary = by_name(P.string_summary(df))
    assert summary["a"].mean == 4.5 and summary["a"].zero_count == 1 and summary["a"].en_words is None
    assert summary["b"].en_words == 5 and summary["c"].type == "string"
    xy = spark.createDataFrame([("1", "2"), ("3", "4"), ("5", "6")], "x string, y string")
    assert [r.type for r in P.string_report(xy).collect()] == ["numeric", "numeric"]
    special = spark.createDataFrame([("inf",), ("NaN",), ("-5",), ("+infinity",)], "s string")
    assert by_name(P.string_report(special))["s"].type == "numeric"
    assert by_name(P.string_report(spark.createDataFrame([], "s string")))["s"].type == "empty"


def test_shape(spark):
    assert P.shape(spark.range(7)).first() == (7, 1)


def test_approximate_median(spark):
    df = spark.range(0, 10001).select(F.col("id").cast("double").alias("v"), F.col("id").cast("string").alias("s"))
    got = by_name(P.profile(df, median_accuracy=1000))
    assert abs(got["v"].median - 5000) <= 20 and abs(got["s"].median - 5000) <= 20 and got["s"].is_inferred


def test_decimals(spark):
    df = spark.sql("select cast(v as decimal(20, 2)) as d from values (1.25), (2.50), (2.50), (null) as t(v)")
    d = by_name(P.profile(df))["d"]
    assert (d.is_numeric, d.mode, d.median, d.none_count, d.na_count) == (True, "2.5", 2.5, 1, 1)


def test_wide_tables(spark):
    """A hundred columns stay within what the JVM compiles."""
    df = spark.range(0, 200).select(*[((F.col("id") * (i + 1)) % 17).cast("double").alias(f"c{i}") for i in range(100)])
    got = by_name(P.profile(df, full=False))
    assert len(got) == 100 and got["c16"].max == 0.0 and got["c0"]["count"] == 200
