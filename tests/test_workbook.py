import pytest
from pyspark.sql import functions as F

from tablelens.plans.fixtures import sheet_xml, workbook_bytes
from tablelens.sources import formats as S
from tablelens.sources import workbook as B


def save(path, sheets):
    path.write_bytes(workbook_bytes(sheets))
    return str(path)


def cells_of(spark, rows):
    return spark.createDataFrame([("f", "s", *r) for r in rows], "file string, sheet string, r int, c int, cell_type string, value string")


def test_typed_table(spark, tmp_path):
    rows = [
        ["name", "n", "ok", None, "share", "mixed", "none"],
        ["a", 1, True, "x", "12.5%", 1, None],
        ["b", 2.5, False, None, "3 %", "y", None],
        [None, None, None, None, None, None, None],
        ["c", 30, None, "z", None, 2.0, None],
    ]
    path = save(tmp_path / "t.xlsx", {"Sheet1": sheet_xml(rows), "Other": sheet_xml([["q"], [7]])})
    df = B.read_workbook(spark, path, with_row=True).orderBy("r")
    assert df.columns[2:] == ["name", "n", "ok", "column_4", "share", "mixed", "none"]
    assert [t for _, t in df.dtypes[2:]] == ["string", "double", "boolean", "string", "double", "string", "string"]
    got = [tuple(r)[2:] for r in df.collect()]
    assert got == [
        ("a", 1.0, True, "x", 0.125, "1", ""),
        ("b", 2.5, False, "", 0.03, "y", ""),
        ("", None, None, "", None, "", ""),
        ("c", 30.0, None, "z", None, "2", ""),
    ]
    other = S.read_table(spark, path, sheet="Other")
    assert [tuple(r) for r in other.collect()] == [(7.0,)]
    with pytest.raises(Exception, match="no sheet"):
        S.read_table(spark, path, sheet="Nope")


def test_merged_regions(spark, tmp_path):
    rows = [["k", "v", "w"], ["top", 1, "wide"], [None, 2, None], [None, 3, None], ["b", 4, None]]
    path = save(tmp_path / "m.xlsx", {"S": sheet_xml(rows, merged=["A2:A4", "C2:C5"])})
    got = B.read_workbook(spark, path, with_row=True).orderBy("r").collect()
    assert [(r.k, r.v, r.w) for r in got] == [("top", 1.0, "wide"), ("top", 2.0, "wide"), ("top", 3.0, "wide"), ("b", 4.0, "wide")]


def test_merge_keeps_filled_cells_and_stays_in_the_sheet(spark):
    cells = cells_of(spark, [(0, 0, "string", "h"), (1, 0, "string", "a"), (2, 0, "string", "own"), (3, 0, "string", "z")])
    regions = spark.createDataFrame([("f", "s", 1, 0, 2, 5), ("f", "s", 9, 9, 10, 10)], "file string, sheet string, r0 int, c0 int, r1 int, c1 int")
    got = {(r.r, r.c): r.value for r in B.fill_merged(cells, regions).collect()}
    assert got == {(0, 0): "h", (1, 0): "a", (2, 0): "own", (3, 0): "z"}


@pytest.mark.parametrize(
    "kinds, want",
    [
        (["bool", "bool"], "boolean"),
        (["int", "int"], "bigint"),
        (["int", "float"], "double"),
        (["float"], "double"),
        (["date", "date"], "string"),
        (["string", "int"], "string"),
        (["error", "int"], "string"),
    ],
)
def test_column_types(spark, kinds, want):
    body = cells_of(spark, [(i, 0, k, "1") for i, k in enumerate(kinds)])
    assert B.column_types(body).first().type == want


def test_whole_numbers_in_cells(spark):
    cells = cells_of(spark, [(0, 0, "string", "n"), (1, 0, "int", "5"), (2, 0, "int", "7")])
    assert [tuple(r)[2:] for r in B.cells_to_table(cells).orderBy("r").collect()] == [(5,), (7,)]


def test_cell_texts(spark):
    rows = [("float", "30.0", "30"), ("error", "", ""), ("bool", "true", "true"), ("date", "45292", "45292"), (None, None, "")]
    df = spark.createDataFrame(rows, "t string, v string, want string")
    for r in df.select("want", B.cell_as_text(F.col("t"), F.col("v")).alias("got")).collect():
        assert r.got == r.want


def test_many_workbooks_and_wrong_files(spark, tmp_path):
    for i in range(3):
        save(tmp_path / f"{i}.xlsx", {"S": sheet_xml([["a", "b"], [i, f"x{i}"]], first_row=3)})
    got = S.read_table(spark, str(tmp_path), format="excel").orderBy("a").collect()
    assert [tuple(r) for r in got] == [(0.0, "x0"), (1.0, "x1"), (2.0, "x2")]
    save(tmp_path / "4.xlsx", {"S": sheet_xml([["other", "b"], [1, "x"]])})
    with pytest.raises(ValueError, match="different headers"):
        S.read_table(spark, str(tmp_path), format="excel")
    bad = tmp_path / "old.xls"
    bad.write_bytes(b"\xd0\xcf\x11\xe0")
    with pytest.raises(Exception, match="not an .xlsx"):
        S.read_table(spark, str(bad))
