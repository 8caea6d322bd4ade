"""What shows only when tables come in several files, or in more rows than one task should hold."""

from collections import defaultdict

from pyspark.sql import functions as F

from tablelens.operators import profile as P
from tablelens.plans import fixtures, queries as registry
from tablelens.session import spread
from tablelens.sources.workbook import read_workbook
from tests.conftest import plan_of


def test_file_lines_are_numbered_by_key_from_many_input_files(spark, sf, tmp_path):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    orders.repartition(16).write.parquet(str(tmp_path / "orders.parquet"))
    want = defaultdict(list)
    for r in orders.orderBy("o_orderkey").collect():
        want[r.o_orderstatus].append(f"{r.o_orderkey} {r.o_orderpriority}")
    got = defaultdict(dict)
    for r in registry.numbered_file_lines(spark, str(tmp_path)).collect():
        got[r.status][r.line_no] = r.line
    assert {s: [lines[i] for i in range(len(lines))] for s, lines in got.items()} == want


def test_rows_that_lie_evenly_are_not_moved(spark, tmp_path):
    even, one = str(tmp_path / "even"), str(tmp_path / "one")
    spark.range(0, 80000, 1, 8).write.parquet(even)
    spark.range(0, 80000, 1, 1).write.parquet(one)
    assert "Exchange" not in plan_of(spread(spark.read.parquet(even)))
    assert "Exchange" in plan_of(spread(spark.read.parquet(one)))


def test_texts_of_numbers_are_parsed_once_for_the_median(spark, monkeypatch):
    seen, real = [], P.exact_medians
    monkeypatch.setattr(P, "exact_medians", lambda df, *a: seen.append([t for _, t in df.dtypes]) or real(df, *a))
    df = spark.range(0, 1001, 1, 3).select(F.col("id").alias("n"), F.format_string(" %d ", "id").alias("s"))
    assert {r.name: r.median for r in P.profile(df).collect()} == {"n": 500.0, "s": 500.0}
    assert seen[-1] == ["double"]


def test_large_inputs_are_counted_in_parts(spark, monkeypatch):
    rows = [(i % 7, float(i % 3), None if i % 5 else -0.0, 2**60 + i % 2) for i in range(500)] + [(0, float("nan"), 0.0, None)] * 3
    df = spark.createDataFrame(rows, "a int, b double, c double, d bigint")
    cols = P._columns(df)

    def counted():
        counts = P._number_counts(df, cols)
        return sorted((r.idx, str(r.whole), str(r.v + 0.0), r.n) for r in counts.collect()), plan_of(counts).count("LocalTableScan") + plan_of(counts).count("Scan ExistingRDD")

    monkeypatch.setattr(P, "COUNT_BYTES", P.SPREAD_BYTES, raising=False)
    whole, scans = counted()
    monkeypatch.setattr(P, "COUNT_BYTES", P.SPREAD_BYTES // 3 + 1)
    monkeypatch.setattr(P, "COUNT_PARTS", 2)
    monkeypatch.setattr(P, "input_bytes", lambda df: 1 << 40)
    parts, more = counted()
    assert parts == whole and len(whole) == 7 + 4 + 1 + 2
    assert (scans, more) == (1, 6)


def test_workbooks_are_written_by_all_cores_and_read_without_joins(spark, tmp_path):
    folder = str(tmp_path / "books")
    fixtures.write_xlsx(spark.range(0, 400, 1, 1).select(F.col("id").alias("n")), folder)
    assert len(list((tmp_path / "books").iterdir())) == 8
    read = read_workbook(spark, folder)
    assert sorted(r.n for r in read.collect()) == list(range(400))
    assert "SortMergeJoin" not in plan_of(read) and "LeftAnti" not in plan_of(read)
