"""Workbooks (.xlsx): cells, merged regions and typed tables.

Files are decoded in parallel, one file per row. All else is done by Spark on the table
of cells (file, sheet, r, c, cell_type, value), so a sheet of any size is spread by cell.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablelens.functions.columns import quoted
from tablelens.functions.numbers import percent_to_fraction, render_double
from tablelens.session import BROADCAST_ROWS, scratch_dir

CELLS = "file string, sheet string, r int, c int, r1 int, c1 int, cell_type string, value string"
BATCH = 50_000
# Built-in number formats that show dates or times.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _tag(element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _position(ref: str) -> tuple[int, int]:
    letters, digits = re.fullmatch(r"([A-Z]+)([0-9]+)", ref).groups()
    column = 0
    for letter in letters:
        column = column * 26 + ord(letter) - 64
    return int(digits) - 1, column - 1


def _part(book: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(book.read(name)) if name in book.namelist() else []


def _texts(element) -> str:
    """All text runs below an element, phonetic hints left out."""
    return "".join(
        t.text or "" for child in element if _tag(child) != "rPh" for t in child.iter() if _tag(t) == "t"
    )


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    custom, styles = {}, set()
    for group in _part(book, "xl/styles.xml"):
        if _tag(group) == "numFmts":
            custom = {int(f.get("numFmtId")): f.get("formatCode") for f in group}
        if _tag(group) == "cellXfs":
            for i, style in enumerate(group):
                number = int(style.get("numFmtId") or 0)
                code = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", custom.get(number, ""))
                if number in DATE_FORMATS or re.search("[dmyhs]", code, re.I):
                    styles.add(i)
    return styles


def _cell(element, strings: list[str], dates: set[int]) -> tuple[str, str] | None:
    kind = element.get("t", "n")
    if kind == "inlineStr":
        return "string", "".join(_texts(x) for x in element if _tag(x) == "is")
    raw = next((x.text for x in element if _tag(x) == "v"), None)
    if raw is None:
        return None
    if kind == "s":
        return "string", strings[int(raw)]
    if kind == "str":
        return "string", raw
    if kind == "b":
        return "bool", "true" if raw == "1" else "false"
    if kind == "n":  # the file format stores every number as a double
        return ("date" if int(element.get("s") or 0) in dates else "float"), raw
    return "error", ""


def _decode(file: str, content: bytes, sheet: str | None):
    """Cells and merged regions of one sheet, the first one unless named."""
    if not zipfile.is_zipfile(io.BytesIO(content)):
        raise ValueError(f"{file} is not an .xlsx workbook")
    book = zipfile.ZipFile(io.BytesIO(content))
    targets = {x.get("Id"): x.get("Target") for x in _part(book, "xl/_rels/workbook.xml.rels")}
    sheets = {}
    for x in _part(book, "xl/workbook.xml").iter():
        if _tag(x) == "sheet":
            link = next(v for k, v in x.attrib.items() if k.endswith("}id"))
            sheets[x.get("name")] = targets[link]
    name = sheet if sheet is not None else next(iter(sheets))
    if name not in sheets:
        raise ValueError(f"{file} has no sheet {name!r}")
    strings = [_texts(x) for x in _part(book, "xl/sharedStrings.xml")]
    dates = _date_styles(book)
    target = sheets[name]
    inner = target.lstrip("/") if target.startswith("/") else "xl/" + target
    row = column = -1  # rows and cells may leave out their reference; they follow the one before
    data = None
    for event, x in ElementTree.iterparse(book.open(inner), ("start", "end")):
        tag = _tag(x)
        if event == "start":
            if tag == "sheetData":
                data = x
            elif tag == "row":
                row, column = int(x.get("r") or row + 2) - 1, -1
            elif tag == "c":
                row, column = _position(x.get("r")) if x.get("r") else (row, column + 1)
        elif tag == "c":
            found = _cell(x, strings, dates)
            if found:
                yield (file, name, row, column, None, None, *found)
        elif tag == "mergeCell":
            start, _, end = x.get("ref").partition(":")
            yield (file, name, *_position(start), *_position(end or start), "merged", None)
        elif tag == "row":
            data.clear()


def decode_workbooks(spark: SparkSession, path: str | list[str], sheet: str | None = None) -> DataFrame:
    """Cells of workbooks, and their merged regions as rows of type 'merged'."""
    columns = [part.split()[0] for part in CELLS.split(", ")]

    def decode(batches):
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                rows = []
                for row in _decode(file, content, sheet):
                    rows.append(row)
                    if len(rows) == BATCH:
                        yield pd.DataFrame(rows, columns=columns).astype({"r1": "Int32", "c1": "Int32"})
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=columns).astype({"r1": "Int32", "c1": "Int32"})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(decode, CELLS)


def split_regions(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, regions) of decoded workbooks."""
    merged = F.col("cell_type") == "merged"
    cells = decoded.where(~merged).select("file", "sheet", "r", "c", "cell_type", "value")
    regions = decoded.where(merged).select(
        "file", "sheet", F.col("r").alias("r0"), F.col("c").alias("c0"), "r1", "c1"
    )
    return cells, regions


def cell_as_text(kind: Column, value: Column) -> Column:
    """Empty and error cells give ''; numbers their shortest text."""
    number = render_double(value.try_cast("double"))
    return F.coalesce(
        F.when(kind.isin("float", "date"), number).when(kind == "error", F.lit("")).otherwise(value), F.lit("")
    )


def fill_merged(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """Give the top-left value of a merged region to the region's empty cells.

    Regions are cut to the used part of their sheet and spelled out as cells, so all joins
    are on (file, sheet, r, c) and no sheet is gathered in one place.
    """
    where = ["file", "sheet"]
    used = cells.groupBy(*where).agg(F.max("r").alias("last_r"), F.max("c").alias("last_c"))
    corner = cells.withColumnsRenamed({"r": "r0", "c": "c0"})
    spelled = (
        regions.join(corner, [*where, "r0", "c0"])
        .join(used, where)
        .where((F.col("r0") <= F.col("last_r")) & (F.col("c0") <= F.col("last_c")))
        .select(
            *where,
            F.explode(F.sequence("r0", F.least("r1", "last_r"))).alias("r"),
            "c0", "c1", "last_c", "cell_type", "value",
        )
        .select(*where, "r", F.explode(F.sequence("c0", F.least("c1", "last_c"))).alias("c"), "cell_type", "value")
    )
    empty = spelled.join(cells.select(*where, "r", "c"), [*where, "r", "c"], "left_anti")
    return cells.unionByName(empty)


def column_types(body: DataFrame) -> DataFrame:
    """(c, type): bool, bigint, double, percent or string, as all non-empty cells of a column agree."""
    kind = F.col("cell_type")
    text_percent = (kind == "string") & F.col("value").endswith("%")
    decided = (
        F.when(F.bool_and(kind == "bool"), "boolean")
        .when(F.bool_and(kind == "int"), "bigint")
        .when(F.bool_and(kind.isin("int", "float")), "double")
        .when(F.bool_and(text_percent), "percent")
        .otherwise("string")
    )
    return body.where(kind != "empty").groupBy("c").agg(decided.alias("type"))


def cells_to_table(cells: DataFrame) -> DataFrame:
    """A table from cells: the first used row is the header, cells decide the types.

    Several files must share one header. Blank headers become column_1, column_2, ...
    Driver traffic: the header and one type per column.
    """
    where = ["file", "sheet"]
    corner = cells.groupBy(*where).agg(
        F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1")
    )
    width, sheets = corner.agg(F.max(F.col("c1") - F.col("c0") + 1), F.count(F.lit(1))).first()
    if not sheets:
        raise ValueError("the sheet is empty")
    # One row per sheet; sent to all tasks while that is small, so a large sheet stays spread.
    sizes = F.broadcast(corner) if sheets <= BROADCAST_ROWS else corner
    placed = cells.join(sizes, where).select(
        *where, "r", "r0", (F.col("c") - F.col("c0")).alias("c"), "cell_type", "value"
    )
    top = placed.where(F.col("r") == F.col("r0"))
    text = cell_as_text(F.col("cell_type"), F.col("value"))
    heads = top.groupBy(*where).agg(
        *[F.max(F.when(F.col("c") == i, text)).alias(f"h{i}") for i in range(width)]
    ).drop(*where).distinct().take(2)
    if len(heads) > 1:
        raise ValueError("the workbooks have different headers")
    names = [h or f"column_{i + 1}" for i, h in enumerate(heads[0])]

    body = placed.where(F.col("r") > F.col("r0")).drop("r0")
    types = dict(column_types(body).collect())
    # Rows without any cell are rows all the same.
    spine = corner.where(F.col("r1") > F.col("r0")).select(
        *where,
        F.explode(F.sequence(F.col("r0") + 1, F.col("r1"))).alias("r"),
        F.lit(0).alias("c"),
        F.lit(None).cast("string").alias("cell_type"),
        F.lit(None).cast("string").alias("value"),
    )
    cell = F.struct("cell_type", "value")
    rows = (
        body.unionByName(spine)
        .groupBy(*where, "r")
        .agg(
            *[
                F.max(F.when((F.col("c") == i) & F.col("cell_type").isNotNull(), cell)).alias(f"c{i}")
                for i in range(width)
            ]
        )
    )

    def typed(i: int) -> Column:
        kind, value = F.col(f"c{i}.cell_type"), F.col(f"c{i}.value")
        wanted = types.get(i, "string")
        if wanted == "percent":
            return percent_to_fraction(value)
        if wanted == "string":
            return cell_as_text(kind, value)
        return value.try_cast(wanted)

    unique = _unique(names)
    return rows.select("file", "r", *[typed(i).alias(n) for i, n in enumerate(unique)])


def _unique(names: list[str]) -> list[str]:
    twice = {n for n in names if names.count(n) > 1}
    if twice:
        raise ValueError(f"header names appear more than once: {sorted(twice)}")
    return names


def read_workbook(
    spark: SparkSession, path: str | list[str], sheet: str | None = None, with_row: bool = False
) -> DataFrame:
    """One sheet of a workbook, or of many with the same header, as a typed table.

    The decoded cells are written once to the shared scratch folder, and once more with merged
    regions filled if there are any, since header, types and rows are separate reads of them. `with_row` keeps the columns file and r, which
    give the sheet order.
    """
    folder = scratch_dir(spark, "workbook")
    decode_workbooks(spark, path, sheet).write.parquet(folder)
    cells, regions = split_regions(spark.read.parquet(folder))
    if not regions.isEmpty():  # header, types and rows would each join the regions again
        filled = scratch_dir(spark, "filled")
        fill_merged(cells, regions).write.parquet(filled)
        cells = spark.read.parquet(filled)
    table = cells_to_table(cells)
    return table if with_row else table.select(*[quoted(c) for c in table.columns[2:]])
