"""Readers: one entry point for every table format, and text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tablelens.session import BROADCAST_BLOCKS
from tablelens.sources.csv_records import csv_records, fields_of, left_open

# File ending -> format. Anything else is text.
FORMATS = {
    "csv": "csv",
    "tsv": "csv",
    "json": "json",
    "ndjson": "json",
    "jsonl": "json",
    "ipc": "ipc",
    "arrow": "ipc",
    "parquet": "parquet",
    "xls": "excel",
    "xlsx": "excel",
    "ods": "excel",
}


def _ending(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    return name.rsplit(".", 1)[-1] if "." in name else ""


def detect_format(path: str) -> str:
    """Format by file ending, upper or lower case; 'text' when none fits."""
    return FORMATS.get(_ending(path), "text")


def is_data_file(path: str) -> bool:
    return detect_format(path) != "text"


def is_text_file(path: str) -> bool:
    return not is_data_file(path)


def default_separator(path: str) -> str:
    return "\t" if _ending(path) == "tsv" else ","


def detected_format(path: Column) -> Column:
    """detect_format as an expression, for a listing of files."""
    ending = F.lower(F.regexp_extract(path, r"\.([^./]+)/?$", 1))
    known = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, ending), F.lit("text"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, format, length) of every file below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", detected_format(F.col("path")).alias("format"), "length")


# --- tables --------------------------------------------------------------


def read_table(
    spark: SparkSession,
    path: str | list[str],
    format: str | None = None,
    sep: str | None = None,
    sheet: str | None = None,
    header: bool = True,
    schema: T.StructType | str | None = None,
    multi_line: bool | None = None,
) -> DataFrame:
    """Read a file, folder or glob as a table.

    The format follows the path's ending unless `format` is given ('csv' forces CSV on any
    path). CSV without a schema costs one more scan that settles the column types.
    """
    first = path if isinstance(path, str) else path[0]
    format = format or detect_format(first)
    if format == "csv":
        return read_csv(spark, path, sep or default_separator(first), header, schema, multi_line)
    if format == "json":
        return (spark.read.schema(schema) if schema else spark.read).json(path)
    if format == "parquet":
        return spark.read.parquet(*([path] if isinstance(path, str) else path))
    if format == "ipc":
        from tablelens.sources.arrow_ipc import read_ipc

        return read_ipc(spark, path)
    if format == "excel":
        from tablelens.sources.workbook import read_workbook

        return read_workbook(spark, path, sheet)
    raise ValueError(f"{first!r} is not a table; read it as text")


def open_quotes(spark: SparkSession, path: str | list[str], sep: str = ",") -> bool:
    """Does a line leave a quoted field open, so that a record goes over several lines?

    One scan that ends at the first such line. Up to that line every line begins a record, so each is
    looked at by itself; inch marks in plain fields open nothing.
    """
    quoted = raw_lines(spark, path).where(F.col("value").contains('"'))
    return not quoted.where(left_open(F.make_valid_utf8("value"), sep)).isEmpty()


def _quoted_records(spark: SparkSession, path: str | list[str], sep: str, header: bool) -> DataFrame:
    """Records with quoted line ends; a file is cut into splits all the same, see `csv_records`."""
    lines = raw_lines(spark, path)
    records = csv_records(lines, sep, block_bound(lines))
    return records.where(F.col("record") > 0).withColumn("record", F.col("record") - 1) if header else records


def _parsed(records: DataFrame, sep: str, schema: T.StructType) -> DataFrame:
    """Records as the columns of a schema, by the rules of the CSV reader."""
    numbered = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema)])
    options = {"sep": sep, "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
    row = F.from_csv("text", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered), options)
    return records.select(row.alias("row")).select("row.*").toDF(*schema.names)


def read_records(
    spark: SparkSession,
    path: str | list[str],
    sep: str | None = None,
    header: bool = True,
    multi_line: bool | None = None,
) -> DataFrame:
    """CSV records as strings only; without a header the columns are column_0, column_1, ...

    Records shorter than the header end in nulls. Fields beyond it are dropped by the CSV
    parser; `read_ragged` keeps them. `multi_line` None looks for quoted line ends first.
    """
    sep = sep or default_separator(path if isinstance(path, str) else path[0])
    if multi_line is None:
        multi_line = open_quotes(spark, path, sep)
    # With quoted line ends this only reads the first record, for the names.
    df = spark.read.csv(path, sep=sep, header=header, inferSchema=False, multiLine=multi_line, mode="PERMISSIVE", escape='"')
    if multi_line:
        df = _parsed(_quoted_records(spark, path, sep, header), sep, df.schema)
    return df if header else df.toDF(*[f"column_{i}" for i in range(len(df.columns))])


def read_ragged(spark: SparkSession, path: str | list[str], sep: str = ",", header: bool = True) -> DataFrame:
    """(file, record, line_no, fields): records of any number of fields, quotes and quoted line ends honoured.

    `record` counts from 0 in each file, `line_no` is that of the record's first line.
    """
    records = _quoted_records(spark, path, sep, header)
    return records.select("file", "record", "line_no", fields_of(F.col("text"), sep).alias("fields"))


def infer_types(records: DataFrame) -> T.StructType:
    """The narrowest type that every value of a string column fits.

    Whole numbers, decimals and true/false are told apart; all else, dates included, stays
    text. One aggregate; one row per column reaches the driver.
    """
    cells = [
        F.struct(F.lit(i).alias("idx"), F.col(f"`{name}`").alias("c")) for i, name in enumerate(records.columns)
    ]
    c = F.col("c")
    whole = c.rlike(r"^[+-]?[0-9]+\z") & c.try_cast("bigint").isNotNull()
    real = c.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z|^(?i)[+-]?(inf|nan)\z")
    long = records.select(F.inline(F.array(*cells))).where(c.isNotNull())
    fits = long.groupBy("idx").agg(
        F.when(F.bool_and(whole), "bigint")
        .when(F.bool_and(real), "double")
        .when(F.bool_and(c.isin("true", "false")), "boolean")
        .alias("type")
    )
    found = {r.idx: r.type for r in fits.collect()}  # one row per column
    simple = {"bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}
    return T.StructType(
        [T.StructField(n, simple.get(found.get(i), T.StringType())) for i, n in enumerate(records.columns)]
    )


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    sep: str = ",",
    header: bool = True,
    schema: T.StructType | str | None = None,
    multi_line: bool | None = None,
) -> DataFrame:
    """CSV as a table. `multi_line` None looks for quoted line ends first, see `open_quotes`."""
    if multi_line is None:
        multi_line = open_quotes(spark, path, sep)
    if schema is None:
        schema = infer_types(read_records(spark, path, sep, header, multi_line))
    if multi_line:
        kinds = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        return _parsed(_quoted_records(spark, path, sep, header), sep, kinds)
    return spark.read.csv(path, sep=sep, header=header, schema=schema, multiLine=False, escape='"')


# --- text ----------------------------------------------------------------


def read_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, text): every file as one string; bytes that are not UTF-8 are replaced."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.make_valid_utf8("value").alias("text")
    )


def raw_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines without numbers: '\\n' ends a line and one '\\r' before it goes too."""
    return spark.read.text(path, lineSep="\n")


def without_cr(c: Column) -> Column:
    return F.when(c.endswith("\r"), c.substr(F.lit(1), F.char_length(c) - 1)).otherwise(c)


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line_no, line): text lines, numbered from 0 within each file."""
    df = raw_lines(spark, path)
    rows = df.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("mid"),
        without_cr(F.col("value")).alias("line"),
    )
    starts = block_starts(rows)
    if block_bound(df) <= BROADCAST_BLOCKS:
        starts = F.broadcast(starts)
    return rows.join(starts, ["file", "block"]).select(
        "file", (F.col("mid") - F.col("first") + F.col("before")).alias("line_no"), "line"
    )


def block_bound(df: DataFrame) -> int:
    """An upper bound on the file blocks a scan reads, known without running a job.

    Every file ends at most one block early, every other block fills a partition.
    """
    return len(df.inputFiles()) + df.rdd.getNumPartitions()


def block_starts(rows: DataFrame) -> DataFrame:
    """(file, block, first, before): first id of each block and lines ahead of it in its file.

    A task reads a block in order, so ids inside a block are consecutive. The scan's
    splits follow from the file sizes, so counting them in a pass of its own is safe.
    """
    sizes = rows.groupBy("file", "block").agg(F.min("mid").alias("first"), F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(
        "file", "block", "first", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before")
    )


def line_count(lines: DataFrame) -> DataFrame:
    """(file, lines)."""
    return lines.groupBy("file").agg(F.count(F.lit(1)).alias("lines"))
