"""Inputs as users have them: Windows lines, quoted line ends, clashing names, bare workbooks."""

import zipfile

import pytest
from pyspark.sql import functions as F

from tablelens.functions.columns import select_columns
from tablelens.functions.numbers import render_double
from tablelens.functions.words import display_width
from tablelens.operators.positions import missing_lines, rows, rows_at, with_position
from tablelens.operators.text_profile import split_paragraphs, text_profile, text_summary
from tablelens.sources.formats import read_csv, read_lines, read_ragged, read_records, read_text
from tablelens.sources.workbook import decode_workbooks


def test_windows_lines_count_like_others(spark):
    text = "a one\r\ntwo\r\n\r\nb\r\n\r\nc"
    docs = spark.createDataFrame([(1, text), (2, text.replace("\r\n", "\n"))], "id int, text string")
    for out in (text_profile(docs, ["id"]), text_summary(docs, ["id"])):
        first, second = (r.asDict() for r in out.orderBy("id").collect())
        assert first.pop("id") == 1 and second.pop("id") == 2
        assert first == second and first["paragraphs"] == 3 and first["soft_lines"] == 4
    found = split_paragraphs(docs.where("id = 1"), ["id"]).orderBy("paragraph_no").collect()
    assert [r.paragraph.strip("\n") for r in found] == ["a one\ntwo", "b", "c"]


def test_quoted_line_ends_stay_in_their_record(spark, tmp_path):
    (tmp_path / "a.csv").write_text('n,t\n1,"x\ny"\n2,z\n')
    path = str(tmp_path / "a.csv")
    assert [tuple(r) for r in read_csv(spark, path).collect()] == [(1, "x\ny"), (2, "z")]
    assert [tuple(r) for r in read_records(spark, path).collect()] == [("1", "x\ny"), ("2", "z")]


def test_header_of_ragged_records_follows_blank_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\nh1,h2\n1\n1,2,3\n")
    found = read_ragged(spark, str(tmp_path / "a.csv")).orderBy("line_no").collect()
    assert [r.fields for r in found] == [["1"], ["1", "2", "3"]]


def test_broken_bytes_are_replaced(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"a\xffb")
    assert read_text(spark, str(tmp_path / "a.txt")).first().text == "a�b"


def test_lines_beyond_the_end_are_reported(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    lines = read_lines(spark, str(tmp_path / "a.txt"))
    assert [(r.line_no, r.lines) for r in missing_lines(lines, "5:9").collect()] == [(5, 2)]
    assert [r.line_no for r in missing_lines(lines, "1,4,2,4").orderBy("line_no").collect()] == [2, 4]
    assert missing_lines(lines, "1:9").collect() == []


@pytest.mark.parametrize("order", [["id"], None])
def test_position_columns_give_way_to_the_tables_own(spark, tmp_path, order):
    spark.range(4).select("id", (F.col("id") * 10).alias("Row"), F.lit("o").alias("ord")).coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert with_position(df, order).columns == ["Row_", "id", "Row", "ord"]
    assert [tuple(r) for r in rows(df, "1:2", order).orderBy("Row_").collect()] == [(1, 1, 10, "o"), (2, 2, 20, "o")]
    assert [tuple(r) for r in rows_at(df, [3, 0], order).collect()] == [(0, 3, 3, 30, "o"), (1, 0, 0, 0, "o")]
    assert rows(df, "1", order, columns="1").columns == ["ord_", "Row_", "Row"]


def test_columns_by_position_when_names_differ_in_case_only(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, A int, `x.y` int")
    assert tuple(select_columns(df, "0:1").first()) == (1, 2)
    assert select_columns(df, "2,1").columns == ["x.y", "A"]


def test_infinities_and_ambiguous_width(spark):
    df = spark.createDataFrame([(float("inf"),), (float("-inf"),), (2.0,)], "v double")
    assert [r[0] for r in df.select(render_double(F.col("v"))).collect()] == ["inf", "-inf", "2"]


def test_workbook_cells_without_references(spark, tmp_path):
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    path = str(tmp_path / "a.xlsx")
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        book.writestr(
            "xl/worksheets/s.xml",
            f'<worksheet xmlns="{main}"><sheetData><row><c><v>1</v></c><c><v>2</v></c></row>'
            '<row r="4"><c r="C4"><v>3</v></c><c><v>4</v></c></row><row><c><v>5</v></c></row></sheetData></worksheet>',
        )
    found = decode_workbooks(spark, path).select("r", "c", "value").orderBy("r", "c").collect()
    assert [tuple(x) for x in found] == [(0, 0, "1"), (0, 1, "2"), (3, 2, "3"), (3, 3, "4"), (4, 0, "5")]


def test_circled_numbers_on_squares_take_one_cell(spark):
    df = spark.createDataFrame([("㉈㉏",), ("㉇㉐",)], "t string")
    assert [r[0] for r in df.select(display_width(F.col("t"))).collect()] == [2, 4]
