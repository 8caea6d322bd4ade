import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tablelens.plans import fixtures
from tablelens.sources import arrow_ipc, formats as S


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


@pytest.mark.parametrize(
    "ending, format",
    [("csv", "csv"), ("TSV", "csv"), ("json", "json"), ("ndjson", "json"), ("jsonl", "json"), ("parquet", "parquet"),
     ("ipc", "ipc"), ("Arrow", "ipc"), ("xlsx", "excel"), ("xls", "excel"), ("ods", "excel"), ("txt", "text"), ("md", "text")],
)
def test_detection(spark, ending, format):
    path = f"/some.dir/data.{ending}"
    assert S.detect_format(path) == format
    assert S.is_data_file(path) == (format != "text") and S.is_text_file(path) == (format == "text")
    got = spark.createDataFrame([(path,)], "p string").select(S.detected_format(F.col("p")).alias("f")).first().f
    assert got == format


def test_no_ending():
    assert S.detect_format("/some.csv/plain") == "text"


def test_listing(spark, tmp_path):
    put(tmp_path, "a.CSV", "x")
    put(tmp_path, "b.txt", "yy")
    got = {r.path.rsplit("/", 1)[1]: (r.format, r.length) for r in S.list_files(spark, str(tmp_path)).collect()}
    assert got == {"a.CSV": ("csv", 1), "b.txt": ("text", 2)}


def test_csv_types(spark, tmp_path):
    path = put(tmp_path, "t.csv", "name,age,score,ok,day,mix\nAlice,30,95.5,true,2024-01-01,1\nBob,25,88,false,2024-01-02,x\nCarol,,92.3,true,,2\n")
    df = S.read_table(spark, path)
    assert [f.dataType.simpleString() for f in df.schema] == ["string", "bigint", "double", "boolean", "string", "string"]
    assert df.count() == 3 and df.orderBy("name").collect()[2].age is None
    assert S.read_table(spark, path, schema="a string, b string, c string, d string, e string, f string").columns[0] == "a"


def test_large_whole_numbers_become_doubles(spark, tmp_path):
    path = put(tmp_path, "t.csv", "a,b\n99999999999999999999,-5\n1,+7\n")
    assert [t for _, t in S.read_table(spark, path).dtypes] == ["double", "bigint"]


def test_tsv_json_and_forced_csv(spark, tmp_path):
    tsv = put(tmp_path, "t.tsv", "name\tage\nAlice\t30\nBob\t25\n")
    assert [tuple(r) for r in S.read_table(spark, tsv).collect()] == [("Alice", 30), ("Bob", 25)]
    js = put(tmp_path, "t.jsonl", '{"name":"Alice","age":30}\n{"name":"Bob","age":25}\n{"name":"Carol","age":35}\n')
    assert S.read_table(spark, js).count() == 3
    dat = put(tmp_path, "t.dat", "col1;col2\nval1;val2\nval3;val4\n")
    assert S.read_table(spark, dat, format="csv", sep=";").columns == ["col1", "col2"]
    with pytest.raises(ValueError):
        S.read_table(spark, dat)


def test_missing_file(spark):
    for name in ("no.csv", "no.parquet", "no.json"):
        with pytest.raises(AnalysisException):
            S.read_table(spark, f"/nowhere/{name}").count()
    with pytest.raises(Exception, match="nowhere"):
        S.read_table(spark, "/nowhere/no.arrow").count()


@pytest.mark.parametrize(
    "name, text, kw, want",
    [
        ("a.csv", "name,age\nAlice,30\nBob,25\n", {}, [("Alice", "30"), ("Bob", "25")]),
        ("b.csv", "Alice,30\nBob,25\n", {"header": False}, [("Alice", "30"), ("Bob", "25")]),
        ("c.tsv", "name\tage\nAlice\t30\nBob\t25\n", {}, [("Alice", "30"), ("Bob", "25")]),
        ("d.csv", "A|B|C\n1|2|3\n", {"sep": "|"}, [("1", "2", "3")]),
        ("e.csv", 'a,b\n"x, ""y""",2\n', {}, [('x, "y"', "2")]),
    ],
)
def test_records(spark, tmp_path, name, text, kw, want):
    df = S.read_records(spark, put(tmp_path, name, text), **kw)
    assert [tuple(r) for r in df.collect()] == want
    if not kw.get("header", True):
        assert df.columns == ["column_0", "column_1"]


def test_empty_records(spark, tmp_path):
    assert S.read_records(spark, put(tmp_path, "e.csv", "")).count() == 0


def test_ragged_records(spark, tmp_path):
    path = put(tmp_path, "r.csv", 'h1,h2\na\nb,c,d\n"x,""y",,\n')
    got = S.read_ragged(spark, path).orderBy("line_no").collect()
    assert [list(r.fields) for r in got] == [["a"], ["b", "c", "d"], ['x,"y', "", ""]]
    tabs = put(tmp_path, "r.tsv", "a\tb\nc\n")
    assert [list(r.fields) for r in S.read_ragged(spark, tabs, "\t", header=False).orderBy("line_no").collect()] == [["a", "b"], ["c"]]


def test_lines(spark, tmp_path):
    path = put(tmp_path, "t.txt", "line1\r\nline2\r\n\r\nla\rst")
    got = S.read_lines(spark, path).orderBy("line_no").collect()
    assert [(r.line_no, r.line) for r in got] == [(0, "line1"), (1, "line2"), (2, ""), (3, "la\rst")]
    assert S.read_lines(spark, put(tmp_path, "e.txt", "")).count() == 0


def test_line_numbers_over_many_splits(spark, tmp_path):
    for name, n in (("a.txt", 3000), ("b.txt", 1777)):
        put(tmp_path, name, "".join(f"{i} {'x' * (i % 50)}\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = S.read_lines(spark, str(tmp_path))
        assert S.raw_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 5
        rows = df.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 4777 and all(int(r.line.split()[0]) == r.line_no for r in rows)


def test_whole_text(spark, tmp_path):
    put(tmp_path, "t.txt", b"ok \xff\r\nnext\n")
    assert S.read_text(spark, str(tmp_path)).first().text == "ok �\r\nnext\n"


def write_ipc(path, table, rows_per_batch):
    with pa.ipc.new_file(str(path), table.schema) as writer:
        writer.write_table(table, max_chunksize=rows_per_batch)


def test_ipc(spark, tmp_path, monkeypatch):
    table = pa.table(
        {
            "id": pa.array(range(1000), pa.int64()),
            "name": pa.array([f"n{i % 5}" for i in range(1000)]).dictionary_encode(),
            "x": pa.array([None if i % 7 == 0 else i / 4 for i in range(1000)]),
            "big": pa.array(["s"] * 1000, pa.large_string()),
            "t": pa.array([1_700_000_000_000_000_123] * 1000, pa.timestamp("ns")),
        }
    )
    write_ipc(tmp_path / "a.arrow", table, 30)
    write_ipc(tmp_path / "b.ipc", table, 1000)
    monkeypatch.setattr(arrow_ipc, "SPLIT_BYTES", 10_000)
    df = S.read_table(spark, str(tmp_path), format="ipc")
    assert df.count() == 2000 and df.agg(F.sum("id")).first()[0] == 2 * 499500
    assert df.where("x is null").count() == 2 * 143
    assert df.where("name = 'n3'").count() == 400
    one = S.read_table(spark, str(tmp_path / "a.arrow"))
    assert one.count() == 1000 and one.select("id").distinct().count() == 1000


def test_ipc_round_trip(spark, sf, tmp_path):
    o = spark.read.parquet(f"{sf}/customer.parquet").repartition(3)
    fixtures.write_ipc(o, str(tmp_path))
    back = S.read_table(spark, str(tmp_path), format="ipc")
    assert back.exceptAll(o).count() == 0 and back.count() == o.count()
