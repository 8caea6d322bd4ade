import random

import pytest
from pyspark.sql import functions as F

from tablelens.operators import positions as R
from tablelens.sources import formats as S
from tests.conftest import plan_of

PEOPLE = [("Alice", 30), ("Bob", 25), ("Carol", 35), ("Dave", 28), ("Eve", 32)]


@pytest.fixture
def people(spark):
    return spark.createDataFrame(PEOPLE, "name string, age long").repartition(3)


def test_row_specs():
    assert R.parse_rows("2,5,9") == [2, 5, 9]
    assert R.parse_rows("3:7") == range(3, 8)
    for bad in ("", "5:2", "1:2:3", "abc", "1,x", ":"):
        with pytest.raises(ValueError):
            R.parse_rows(bad)


def test_head_and_tail(people):
    assert [r.name for r in R.head(people, 3, ["name"]).collect()] == ["Alice", "Bob", "Carol"]
    assert [r.name for r in R.tail(people, 2, ["name"]).collect()] == ["Dave", "Eve"]
    assert [r.name for r in R.tail(people, 10, ["name"]).collect()] == [n for n, _ in PEOPLE]
    assert R.numbered_head(people, 1, ["name"]).columns == ["0", "1"]


def test_top_n_without_a_global_sort(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    for df in (R.head(o, 5, ["o_orderkey"]), R.tail(o, 5, ["o_orderkey"])):
        plan = plan_of(df)
        assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_any_number_of_rows(people):
    names = ["Alice", "Bob", "Carol", "Dave", "Eve"]
    for n in (5, 200_000):
        assert [r.name for r in R.head(people, n, ["name"]).collect()] == names
        assert [r.name for r in R.tail(people, n, ["name"]).collect()] == names
        assert R.head(people.limit(0), n, ["name"]).collect() == R.tail(people.limit(0), n, ["name"]).collect() == []
    own = people.withColumn("Row", F.lit(1))
    assert R.head(own, 200_000, ["name"]).columns == own.columns


@pytest.fixture
def hot(spark):
    """A third of the rows share the leading key; some keys are null."""
    rng = random.Random(3)
    lead = [("hot" if rng.random() < 0.34 else None if rng.random() < 0.02 else rng.choice("abcdexyz")) for _ in range(3000)]
    rows = [(k, i, float(i % 97)) for i, k in enumerate(lead)]
    return rows, spark.createDataFrame(rows, "k string, id long, v double").repartition(5)


def in_order(rows):
    return sorted(rows, key=lambda r: ((r[0] is not None, r[0] or ""), r[1]))


def test_positions_with_a_hot_key(hot):
    rows, df = hot
    got = R.with_position(df, ["k", "id"], rows_per_range=100).collect()
    assert sorted((r.Row, r.id) for r in got) == [(i, r[1]) for i, r in enumerate(in_order(rows))]
    index = R.build_index(df, ["k", "id"], rows_per_range=100)
    sizes = [b - a for a, b in zip(index.starts, index.starts[1:])]
    assert len(sizes) > 15 and max(sizes) < 600  # the hot key alone has about 1000 rows


@pytest.mark.parametrize("start, end", [(0, 10), (990, 1200), (2995, 9999), (0, 2999)])
def test_ranges(hot, start, end):
    rows, df = hot
    want = [(i, r[1]) for i, r in enumerate(in_order(rows))][start : end + 1]
    got = R.rows_between(df, start, end, ["k", "id"], rows_per_range=150).collect()
    assert sorted((r.Row, r.id) for r in got) == want


@pytest.mark.parametrize("keys", [["id"], ["v", "id"]])
def test_ranges_by_other_keys(hot, keys):
    rows, df = hot
    at = {"id": 1, "v": 2}
    want = sorted(rows, key=lambda r: [r[at[k]] for k in keys])[700:900]
    got = R.rows_between(df, 700, 899, keys, rows_per_range=100)
    assert sorted((r.Row, r.id) for r in got.collect()) == [(700 + i, r[1]) for i, r in enumerate(want)]


def test_ranges_by_time(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("ts", "event_id")
    want = [r.event_id for r in e.orderBy("ts", "event_id").collect()][300:500]
    got = R.rows_between(e, 300, 499, ["ts", "event_id"], rows_per_range=64).orderBy("Row").collect()
    assert [r.event_id for r in got] == want


def test_equal_keys_are_cut_up_too(spark):
    df = spark.range(0, 3000, 1, 4).select(F.lit("same").alias("k"), "id")
    index = R.build_index(df, ["k"], rows_per_range=200)
    assert len(index.starts) > 10 and max(b - a for a, b in zip(index.starts, index.starts[1:])) < 900
    got = index.all().collect()
    assert sorted(r.Row for r in got) == list(range(3000)) and len({r.id for r in got}) == 3000


def test_an_index_is_used_again(spark, hot, tmp_path):
    rows, df = hot
    odd = df.toDF("k", "id", "a.b, c").selectExpr("*", "null as nothing", "7 as Row")
    R.build_index(odd, ["k", "id"], str(tmp_path / "index"), rows_per_range=300)
    index = R.open_index(spark, str(tmp_path / "index"))
    want = in_order(rows)
    assert index.total == 3000
    got = index.between(1000, 1010, "Row_")
    assert got.columns == ["Row_", "k", "id", "a.b, c", "nothing", "Row"]
    assert sorted((r.Row_, r.id) for r in got.collect()) == [(i, want[i][1]) for i in range(1000, 1011)]
    assert files_read(index.between(1000, 1010, "Row_"))[0] in (1, 2)
    assert [r.id for r in index.ordered(2990, 2999).collect()] == [r[1] for r in want[2990:]]
    assert index.ordered(5, 4).collect() == []


def test_many_first_and_last_rows(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(R, "TOP_N", 10)
    df = spark.range(0, 1000, 1, 4).select((F.col("id") * 7 % 1000).alias("x"))
    assert [r.x for r in R.head(df, 600, ["x"]).collect()] == list(range(600))
    assert [r.x for r in R.tail(df, 600, ["x"]).collect()] == list(range(400, 1000))
    path = str(tmp_path / "f")
    df.repartitionByRange(4, "x").sortWithinPartitions("x").write.parquet(path)
    back = spark.read.parquet(path)
    assert [r.x for r in R.head(back, 600).collect()] == list(range(600))
    assert [r.x for r in R.tail(back, 600).collect()] == list(range(400, 1000))
    assert [r.x for r in R.tail(back, 5000).collect()] == list(range(1000))


def test_range_beyond_the_end(people):
    with pytest.raises(ValueError):
        R.rows_between(people, 5, 9, ["name"])


def test_a_range_opens_its_own_ranges_only(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey")
    index = R.build_index(o, ["o_orderkey"], rows_per_range=100)
    got = index.between(index.starts[3], index.starts[5] - 1)
    assert files_read(got) == [2] and "SinglePartition" not in plan_of(got)
    assert files_read(index.at([index.starts[2], index.starts[9], 10**9])) == [2]


def test_chosen_rows(people):
    got = R.rows_at(people, [3, 0, 3, 99], ["name"]).collect()
    assert [(r.ord, r.Row, r.name) for r in got] == [(0, 3, "Dave"), (1, 0, "Alice"), (2, 3, "Dave")]
    assert R.rows_at(people, [77], ["name"]).collect() == []
    assert [tuple(r) for r in R.missing_rows(people, [3, 99, 99]).collect()] == [(99, 5)]


def test_rows_command(people):
    got = R.rows(people, "1:2", ["name"], columns="age", numbered=True).orderBy("Row").collect()
    assert [tuple(r) for r in got] == [(1, 25), (2, 35)]
    cut = R.rows(people, "0", ["name"], truncated=True).first()
    assert (cut.ord, cut.Row, cut.name, cut.age) == (0, 0, "Alice", "30")


def test_file_order(spark, tmp_path):
    df = spark.range(0, 1000, 1, 1).select("id", (F.col("id") * 7 % 1000).alias("x"))
    for fmt in ("parquet", "csv", "json"):
        path = str(tmp_path / fmt)
        df.repartitionByRange(4, "id").sortWithinPartitions("id").write.format(fmt).save(path)
        back = spark.read.schema("id long, x long").format(fmt).load(path)
        got = R.with_position(back).collect()
        assert sorted((r.Row, r.id) for r in got) == [(i, i) for i in range(1000)]
        assert [r.id for r in R.head(back, 3).collect()] == [0, 1, 2]
        assert [r.id for r in R.head(back, 600).collect()] == list(range(600))
        assert [r.id for r in R.tail(back, 3).collect()] == [997, 998, 999]
        assert [r.id for r in R.rows_at(back, [500, 2]).collect()] == [500, 2]
        assert [(r.Row, r.id) for r in R.rows_at(back, [999, 10**9, 0, 999]).collect()] == [(999, 999), (0, 0), (999, 999)]
        assert R.rows_at(back, [5000]).collect() == []
        assert sorted(r.id for r in R.rows_between(back, 990, 2000).collect()) == list(range(990, 1000))
        assert sorted((r.Row, r.id) for r in R.rows_between(back, 240, 260).collect()) == [(i, i) for i in range(240, 261)]
        with pytest.raises(ValueError):
            R.rows_between(back, 1000, 1001)


def test_a_range_opens_its_own_files_only(spark, tmp_path):
    path = str(tmp_path / "many")
    spark.range(0, 1000, 1, 1).repartitionByRange(5, "id").sortWithinPartitions("id").write.parquet(path)
    df = spark.read.parquet(path)
    got = R.rows_between(df, 500, 505)
    assert sorted((r.Row, r.id) for r in got.collect()) == [(i, i) for i in range(500, 506)]
    assert "file_path" in plan_of(got)
    assert sorted(r.id for r in R.rows_between(df, 100, 900).collect()) == list(range(100, 901))


def files_read(df) -> list[int]:
    """Files each scan of the executed plan has opened."""
    df.collect()
    counts = []

    def walk(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "QueryStage" in node.nodeName():
            return walk(node.plan())
        if node.metrics().contains("numFiles"):
            counts.append(node.metrics().get("numFiles").get().value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return counts


def test_the_first_file_is_enough_for_a_few_rows(spark, tmp_path):
    path = str(tmp_path / "many")
    spark.range(0, 1000, 1, 1).repartitionByRange(5, "id").write.parquet(path)
    df = spark.read.parquet(path)
    assert files_read(R.head(df, 3)) == [1] and files_read(R.tail(df, 3)) == [1]
    assert set(files_read(R.rows_between(df, 500, 505))) == {1}


def lines(spark, texts):
    rows = [(f"f{i}", n, line) for i, t in enumerate(texts) for n, line in enumerate(t)]
    return spark.createDataFrame(rows, "file string, line_no long, line string")


def test_line_segments(spark):
    five = lines(spark, [[f"line{i}" for i in range(1, 6)]])
    assert [r.line for r in R.line_segment(five, 1, 3).collect()] == ["line2", "line3", "line4"]
    assert [r.line for r in R.line_segment(five, 4, 3).collect()] == ["line5"]
    assert R.line_segment(five, 9, 3).collect() == []
    assert S.line_count(five).first().lines == 5
    assert [r.line for r in R.head_lines(five, 2).collect()] == ["line1", "line2"]
    assert [r.line for r in R.tail_lines(five, 2).collect()] == ["line4", "line5"]


def test_rows_of_lines(spark):
    six = lines(spark, [[f"L{i}" for i in range(6)]])
    assert [r.line for r in R.rows_of_lines(six, "5,1,3").orderBy("ord").collect()] == ["L5", "L1", "L3"]
    assert [r.line for r in R.rows_of_lines(six, "1:3").orderBy("line_no").collect()] == ["L1", "L2", "L3"]
    with pytest.raises(ValueError):
        R.rows_of_lines(six, "6:9")
    long = lines(spark, [["Hello world this is a test"]])
    assert R.rows_of_lines(long, "0", 20).first().line == "Hello world this is\na test"


def test_clock_times_do_not_depend_on_the_time_zone(spark):
    """New York repeats an hour on that day; positions follow the calendar all the same."""
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql("select timestamp_ntz'2024-11-03 00:00:00' + make_dt_interval(0, 0, 0, id * 7.3) as t, id from range(0, 2000)")
        got = R.with_position(df.repartition(3), ["t"], rows_per_range=50).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert sorted((r.Row, r.id) for r in got) == [(i, i) for i in range(2000)]
