import pytest
from pyspark.sql import functions as F

from tablelens.functions import columns as C
from tablelens.functions import numbers as N


def test_specs():
    assert C.parse_columns("0,2,4") == [0, 2, 4]
    assert C.parse_columns("0:3") == [0, 1, 2, 3]
    assert C.parse_columns("name, age,score") == ["name", "age", "score"]
    assert C.parse_columns("1,age") == ["1", "age"]
    for bad in ("", " ", ",", "5:2"):
        with pytest.raises(ValueError):
            C.parse_columns(bad)


def test_selection(spark):
    df = spark.createDataFrame([("Alice", 30, 95)], "name string, age long, score long")
    assert C.select_columns(df, "0,2").columns == ["name", "score"]
    assert C.select_columns(df, "score").columns == ["score"]
    assert C.select_columns(df, None).columns == df.columns
    for bad in ("5", "nobody"):
        with pytest.raises(ValueError):
            C.select_columns(df, bad)
    assert C.number_columns(df).columns == ["0", "1", "2"]
    dotted = spark.createDataFrame([(1,)], "`a.b` int")
    assert C.select_columns(dotted, "a.b").columns == ["a.b"]


def test_rendering(spark):
    df = spark.createDataFrame([("a long customer name", None, [1, 2])], "name string, n int, l array<int>")
    cut = C.truncate_cells(df).first()
    assert (cut.name, cut.n, cut.l) == ("a long ...", "null", "[1,2]")
    assert df.select(C.render_tsv(df)).first().line == "a long customer name\tnull\t[1,2]"
    assert C.tsv_header(df) == "name\tn\tl"


def test_percent(spark):
    df = spark.createDataFrame([("12.5%", "1%", "%"), (" 3 %", "x", "a%"), (None, "2%", "")], "a string, b string, c string")
    got = C.normalise_percent(df).collect()
    assert [r.a for r in got] == [0.125, 0.03, None]
    assert [r.b for r in got] == ["1%", "x", "2%"]
    assert [r.c for r in got] == [None, None, None]


def test_numbers(spark):
    rows = [(20.0, "20"), (1e7, "10000000"), (-1.25e-7, "-0.000000125"), (1.5e300, "15" + "0" * 299), (0.1, "0.1"), (123456789.125, "123456789.125"), (1.5e22, "15" + "0" * 21)]
    df = spark.createDataFrame(rows, "d double, want string")
    for r in df.select("*", N.render_double(F.col("d")).alias("got")).collect():
        assert r.got == r.want
    words = ["1d", "1.5f", "0x10", "", " ", "1 2", "--1", "1\n", None]
    bad = spark.createDataFrame([(w,) for w in words], "s string").select(N.parse_any(F.col("s")).alias("x"), "s").collect()
    assert [r.x for r in bad] == [None] * len(words)
