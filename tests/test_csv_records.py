"""CSV records with quoted line ends, read in many splits, against Python's csv module."""

import csv
import io
import random

import pytest

from tablelens.operators.row_profile import record_fields
from tablelens.sources import csv_records as C
from tablelens.sources import formats as S


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum") if spark.conf.get(k, None)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.set(k, old[k]) if k in old else spark.conf.unset(k)


def test_states_of_lines():
    assert not C.stays_open("a,b", ",", False) and C.stays_open("a,b", ",", True)
    assert C.stays_open('a,"b', ",", False) and not C.stays_open('b",c', ",", True)
    assert not C.stays_open('5" pipe,x', ",", False)  # an inch mark opens nothing
    assert C.stays_open('"a""', ",", False) and not C.stays_open('"a"""', ",", False)
    assert C.stays_open('x",y,"z', ",", True)
    assert C.split_fields('1,"a ""b"", c",,5" x,"d\ne"', ",") == ["1", 'a "b", c', "", '5" x', "d\ne"]
    assert C.split_fields("", ",") == [""] and C.split_fields('"open', ",") == ["open"]


def random_rows(rng, n):
    words = ["x", "yy", "", "a b", "line\nend", 'in "quotes"', "1,2", "\n", '"', 'é"\n,"', "long " * 40]
    return [[str(i), *rng.choices(words, k=rng.randint(1, 4))] for i in range(n)]


def as_file(rows, end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_ragged_records_in_many_splits(spark, tmp_path, small_splits, end):
    rng = random.Random(len(end))
    files = {f"f{k}.csv": random_rows(rng, 200) for k in range(3)}
    files["blank.csv"], files["none.csv"] = [["only"]], []
    for name, rows in files.items():
        (tmp_path / name).write_bytes((as_file(rows, end) + ("\n  \n" if name == "blank.csv" else "")).encode())
    df = S.read_ragged(spark, str(tmp_path), header=False)
    assert S.raw_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 20
    got = {}
    for r in df.collect():
        got.setdefault(r.file.rsplit("/", 1)[-1], {})[r.record] = list(r.fields)
    for name, rows in files.items():
        assert [got.get(name, {}).get(i) for i in range(len(got.get(name, {})))] == rows
    first = S.read_ragged(spark, str(tmp_path / "f1.csv"), header=True).where("record = 0").first()
    assert list(first.fields) == files["f1.csv"][1]
    # A record's line number is that of its first line.
    text = as_file(files["f0.csv"], end)
    lines = {r.record: r.line_no for r in df.collect() if r.file.endswith("f0.csv")}
    at = 0
    for i, row in enumerate(files["f0.csv"]):
        assert lines[i] == at
        at += as_file([row], end).count("\n")
    assert text.count("\n") == at


def test_a_record_longer_than_many_splits(spark, tmp_path, small_splits):
    long = "word\n" * 2000
    (tmp_path / "a.csv").write_text(as_file([["k", "t"], ["1", "x"], ["2", long], ["3", 'y "z"'], ["4", "\n" + long], ["5", ""]]))
    (tmp_path / "b.csv").write_text('k,t\n6,never closed "\n7,"open to the end\nof the file\n')
    got = {r.k: r.t for r in S.read_records(spark, str(tmp_path)).collect()}
    assert got == {"1": "x", "2": long, "3": 'y "z"', "4": "\n" + long, "5": None, "6": 'never closed "', "7": "open to the end\nof the file"}
    typed = S.read_csv(spark, str(tmp_path / "a.csv"))
    assert dict(typed.dtypes) == {"k": "bigint", "t": "string"}
    assert sorted(r.k for r in typed.collect()) == [1, 2, 3, 4, 5]
    assert S.read_csv(spark, str(tmp_path / "a.csv"), schema="k int, t string").where("k = 4").first().t == "\n" + long


def test_quotes_are_found_where_they_open(spark, tmp_path):
    (tmp_path / "inch.csv").write_text('a,b\n1,5" pipe\n2,7"\n')
    assert not S.open_quotes(spark, str(tmp_path / "inch.csv"))
    assert [tuple(r) for r in S.read_csv(spark, str(tmp_path / "inch.csv")).collect()] == [(1, '5" pipe'), (2, '7"')]
    (tmp_path / "both.csv").write_text('a,b,c,d\n1,5" pipe,"x\ny",6"\n')  # every line has an even number of quotes
    assert [tuple(r) for r in S.read_csv(spark, str(tmp_path / "both.csv")).collect()] == [(1, '5" pipe', "x\ny", '6"')]


def test_fields_of_each_record(spark, tmp_path):
    (tmp_path / "r.csv").write_text('h\na\nb c,"d e\nf",g\n\n1,2,3,4\n')
    got = record_fields(S.read_ragged(spark, str(tmp_path / "r.csv")), 2).orderBy("record").collect()
    assert [(r.record, r.fields, r.words) for r in got] == [(0, 1, 1), (1, 3, 6)]
