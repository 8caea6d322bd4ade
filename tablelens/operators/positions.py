"""Rows by position: first, last, ranges and chosen rows.

A DataFrame has no order of its own, so every operator takes `order_by`, a list of
columns that together are unique. Without it, rows count in file order: files by path,
rows as they stand in the file; this needs a frame that comes straight from a file scan.

Positions by key come from a stored index: the table written once in key order, cut into ranges, with
the number of rows in each. Lookups open only the files of the ranges they touch. `build_index` makes an
index that can be used again and opened by later sessions; the other operators make their own.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tablelens.functions.columns import (
    free_name,
    number_columns,
    quoted,
    select_columns,
    truncate_cells,
)
from tablelens.functions.words import wrap_lines
from tablelens.session import BROADCAST_BLOCKS, BROADCAST_ROWS, scratch_dir
from tablelens.sources.formats import block_bound

#: Rows of one range of a stored index, if the table has more than a core's share of them.
ROWS_PER_RANGE = 2_000_000
#: Fewer rows than this are not spread over more ranges.
LEAST_ROWS = 10_000
#: Up to this many first or last rows are picked by top-n selection, more by a stored index; the rows are the same.
TOP_N = 100_000


# --- row specs -----------------------------------------------------------


def parse_rows(spec: str) -> range | list[int]:
    """A row spec: '3:7' (inclusive range) or '2,5,9' (rows in the order asked for)."""
    spec = spec.strip()
    if not spec:
        raise ValueError("row selection is empty")

    def number(text: str) -> int:
        text = text.strip()
        if not (text.isascii() and text.removeprefix("+").isdigit()):
            raise ValueError(f"not a row number: {text!r}")
        return int(text)

    if ":" in spec:
        ends = spec.split(":")
        if len(ends) != 2:
            raise ValueError(f"a row range has one colon: {spec!r}")
        start, end = (number(e) for e in ends)
        if start > end:
            raise ValueError(f"row range starts at {start}, after its end {end}")
        return range(start, end + 1)
    rows = [number(part) for part in spec.split(",") if part.strip()]
    if not rows:
        raise ValueError(f"not a row selection: {spec!r}")
    return rows


# --- order and position --------------------------------------------------


def _file_order() -> list[Column]:
    """Sort keys of file order; ids grow within the block a task reads."""
    return [
        F.col("_metadata.file_path"),
        F.col("_metadata.file_block_start"),
        F.monotonically_increasing_id(),
    ]


def _rows_ahead(sizes: DataFrame) -> DataFrame:
    """(__file, __ahead, __n) from counts per file (or per block): rows in the files before."""
    earlier = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    per_file = sizes.groupBy("__file").agg(F.sum("__n").alias("__n"))
    return per_file.select("__file", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__ahead"), "__n")


def _file_positions(df: DataFrame, name: str, files: DataFrame | None = None) -> DataFrame:
    """Positions in file order without moving any data.

    A position is the rows in earlier files and blocks plus the offset in the block. Only
    the block sizes are summed up, one row per file block. `files` holds known (__file,
    __ahead) when `df` reads only some of the files.
    """
    rows = df.select(
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__mid"),
        *[quoted(c) for c in df.columns],
    )
    sizes = rows.groupBy("__file", "__block").agg(
        F.min("__mid").alias("__first"), F.count(F.lit(1)).alias("__n")
    )
    until_now = Window.partitionBy("__file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    in_file = F.coalesce(F.sum("__n").over(until_now), F.lit(0))
    ahead = files if files is not None else _rows_ahead(sizes)
    starts = (
        sizes.select("__file", "__block", "__first", in_file.alias("__in_file"))
        .join(ahead.select("__file", "__ahead"), "__file")
        .select("__file", "__block", "__first", (F.col("__in_file") + F.col("__ahead")).alias("__before"))
    )
    if block_bound(df) <= BROADCAST_BLOCKS:
        starts = F.broadcast(starts)
    position = F.col("__mid") - F.col("__first") + F.col("__before")
    return rows.join(starts, ["__file", "__block"]).select(
        position.alias(name), *[quoted(c) for c in df.columns]
    )


def _positions_of(df: DataFrame, wanted: range | list[int], name: str) -> DataFrame | None:
    """Rows with positions from the files that hold a wanted position; None if none does.

    Counting rows per file needs no columns; after that only the files that matter are read. The driver
    gets one row per file, as it does when it lists them.
    """
    counted = df.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    files = sorted((r.file, r.n) for r in counted.collect())
    starts = [0, *accumulate(n for _, n in files)]
    path = F.col("_metadata.file_path")
    if isinstance(wanted, range):  # neighbours: two bounds name them
        if wanted.start >= starts[-1]:
            return None
        first, last = (bisect_right(starts, p) - 1 for p in (wanted.start, min(wanted[-1], starts[-1] - 1)))
        hit, chosen = range(first, last + 1), path.between(files[first][0], files[last][0])
    else:
        hit = sorted({bisect_right(starts, p) - 1 for p in wanted if p < starts[-1]})
        if not hit:
            return None
        chosen = path.isin([files[i][0] for i in hit])
    known = df.sparkSession.createDataFrame([(files[i][0], starts[i]) for i in hit], "__file string, __ahead bigint")
    return _file_positions(df.where(chosen), name, known)


_ROW_IN_RANGE = (1 << 33) - 1  # the part of a monotonically increasing id that counts within a task


@dataclass
class PositionIndex:
    """A table in key order below a folder: one folder per range of keys, `starts` rows ahead of each.

    Columns are stored under numbers, with their names as metadata, so any names do.
    """

    spark: SparkSession
    path: str
    schema: T.StructType  # as stored
    starts: list[int]  # rows ahead of each range, and the total at the end

    @property
    def total(self) -> int:
        return self.starts[-1]

    def range_of(self, position: int) -> int:
        return bisect_right(self.starts, position) - 1

    def _rows(self, name: str, chosen: Column | None = None) -> DataFrame:
        """The rows of the chosen ranges (a condition on `part` that prunes folders) with their positions."""
        df = self.spark.read.schema(self.schema).parquet(self.path)
        if chosen is not None:
            df = df.where(chosen)
        ahead = F.get(F.from_json(F.lit(json.dumps(self.starts)), "array<bigint>", {"mode": "FAILFAST"}), F.col("part"))
        fields = [f for f in self.schema if "name" in f.metadata]
        back = [(F.lit(None) if f.metadata["void"] else F.col(f.name)).alias(f.metadata["name"]) for f in fields]
        return df.select((ahead + F.col("at")).alias(name), *back)

    def all(self, name: str = "Row") -> DataFrame:
        """Every row with its position."""
        return self._rows(name)

    def between(self, start: int, end: int, name: str = "Row") -> DataFrame:
        """Rows start..end, the end cut to the last row."""
        if start >= self.total:
            raise ValueError(f"start row {start} is out of range, there are {self.total} rows")
        first, last = self.range_of(start), self.range_of(min(end, self.total - 1))
        return self._rows(name, F.col("part").between(first, last)).where(quoted(name).between(start, end))

    def at(self, wanted: list[int], name: str = "Row") -> DataFrame:
        """The ranges that hold a wanted row; those beyond the last row are in none."""
        hit = sorted({self.range_of(p) for p in wanted if p < self.total})
        return self._rows(name, F.col("part").isin(hit) if hit else F.lit(False))

    def ordered(self, start: int, end: int) -> DataFrame:
        """Rows start..end in order, without their positions."""
        names = [f.metadata["name"] for f in self.schema if "name" in f.metadata]
        name = free_name("Row", names)
        if not 0 <= start <= min(end, self.total - 1):
            return self._rows(name, F.lit(False)).drop(name)
        return self.between(start, end, name).orderBy(quoted(name)).drop(name)


def build_index(
    df: DataFrame, order_by: list[str], path: str | None = None, rows_per_range: int = ROWS_PER_RANGE
) -> PositionIndex:
    """Write `df` in key order below `path` (the session's scratch folder if None).

    Ranges are whole keys and then the place in the input, so a key that a third of the rows share is cut
    up as well. Rows of equal keys keep no particular order among each other.
    """
    spark = df.sparkSession
    path = path or scratch_dir(spark, "positions")
    total = df.count()
    cores = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, -(-total // rows_per_range), min(cores, total // LEAST_ROWS))
    stored = [
        (F.lit(None).cast("boolean") if isinstance(f.dataType, T.NullType) else quoted(f.name)).alias(
            f"c{i}", metadata={"name": f.name, "void": isinstance(f.dataType, T.NullType)}
        )
        for i, f in enumerate(df.schema)
    ]
    by = [F.col(f"c{df.columns.index(k)}") for k in order_by]
    dealt = df.select(*stored, F.monotonically_increasing_id().alias("mid")).repartitionByRange(ranges, *by, "mid")
    # Sorted by folder first, so that the writer has nothing left to sort.
    placed = dealt.withColumn("part", F.spark_partition_id()).sortWithinPartitions("part", *by, "mid").drop("mid")
    placed = placed.withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_IN_RANGE)))
    placed.write.partitionBy("part").parquet(path)
    schema = T.StructType([*[f for f in placed.schema if f.name != "part"], T.StructField("part", T.IntegerType())])
    return _opened(spark, path, schema)


def open_index(spark: SparkSession, path: str) -> PositionIndex:
    """An index that `build_index` wrote."""
    found = spark.read.option("mergeSchema", "false").parquet(path).schema
    fields = [f for f in found if f.name != "part"]
    return _opened(spark, path, T.StructType([*fields, T.StructField("part", T.IntegerType())]))


def _opened(spark: SparkSession, path: str, schema: T.StructType) -> PositionIndex:
    sizes = spark.read.schema(schema).parquet(path).groupBy("part").count().collect()  # one row per range
    rows = {r.part: r["count"] for r in sizes}
    return PositionIndex(spark, path, schema, [0, *accumulate(rows.get(i, 0) for i in range(max(rows, default=-1) + 1))])


def with_position(
    df: DataFrame,
    order_by: list[str] | None = None,
    name: str = "Row",
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Put the 0-based row position in front of every row.

    Here and below, a position column whose name the table has already gets underscores added.
    """
    name = free_name(name, df.columns)
    if order_by is None:
        return _file_positions(df, name)
    return build_index(df, order_by, rows_per_range=rows_per_range).all(name)


# --- first and last rows -------------------------------------------------


def head(df: DataFrame, n: int = 5, order_by: list[str] | None = None) -> DataFrame:
    """The first n rows, in order, for any n; all rows when there are no more than n."""
    if order_by is None:
        first = _edge_files(df, n, last=False)
        if n <= TOP_N:
            return first.orderBy(*_file_order()).limit(n)
        name = free_name("Row", df.columns)
        found = _file_positions(first, name)
        return found.where(quoted(name) < n).orderBy(quoted(name)).drop(name)
    if n > TOP_N:
        return build_index(df, order_by).ordered(0, n - 1)
    return df.orderBy(*[quoted(k) for k in order_by]).limit(n)


def tail(df: DataFrame, n: int = 5, order_by: list[str] | None = None) -> DataFrame:
    """The last n rows, in order; all rows when there are no more than n."""
    if order_by is not None:
        if n > TOP_N:
            index = build_index(df, order_by)
            return index.ordered(max(0, index.total - n), index.total - 1)
        keys = [quoted(k) for k in order_by]
        return df.orderBy(*[k.desc() for k in keys]).limit(n).orderBy(*keys)
    if n > TOP_N:
        name = free_name("Row", df.columns)
        found = _file_positions(df, name)
        return found.where(quoted(name) >= df.count() - n).orderBy(quoted(name)).drop(name)
    keys = [f"__k{i}" for i in range(3)]
    keyed = _edge_files(df, n, last=True).select(
        *[k.alias(a) for k, a in zip(_file_order(), keys)], *[quoted(c) for c in df.columns]
    )
    picked = keyed.orderBy(*[F.col(k).desc() for k in keys]).limit(n)
    return picked.orderBy(*keys).drop(*keys)


def _edge_files(df: DataFrame, n: int, last: bool) -> DataFrame:
    """Only the first (or last) files that hold n rows, so the rest are not opened."""
    names = sorted(df.inputFiles(), reverse=last)
    # Local files are listed as file:///x, but their rows carry file:/x.
    spelled = [n.replace("file:///", "file:/", 1) for n in names]
    take = 1
    while take < len(names):
        part = df.where(F.col("_metadata.file_path").isin(names[:take] + spelled[:take]))
        if part.limit(n).count() >= n:
            return part
        take *= 4
    return df


# --- chosen rows ---------------------------------------------------------


def rows_between(
    df: DataFrame,
    start: int,
    end: int,
    order_by: list[str] | None = None,
    name: str = "Row",
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Rows start..end (inclusive, end cut to the last row) with their position in front."""
    name = free_name(name, df.columns)
    if order_by is not None:
        return build_index(df, order_by, rows_per_range=rows_per_range).between(start, end, name)
    found = _positions_of(df, range(start, end + 1), name)
    if found is None:
        raise ValueError(f"start row {start} is out of range")
    return found.where(quoted(name).between(start, end))


def rows_at(
    df: DataFrame,
    wanted: list[int],
    order_by: list[str] | None = None,
    name: str = "Row",
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """The wanted rows in the order asked for, repeats repeated; `ord` gives that order.

    Positions beyond the last row are left out, see `missing_rows`.
    """
    spark = df.sparkSession
    name, order = free_name(name, df.columns), free_name("ord", df.columns)
    asked = spark.createDataFrame(list(enumerate(wanted)), T.StructType([T.StructField(c, T.LongType()) for c in (order, name)]))
    if order_by is not None:
        rows = build_index(df, order_by, rows_per_range=rows_per_range).at(wanted, name)
    else:
        rows = _positions_of(df, wanted, name)
        if rows is None:
            rows = df.select(F.lit(0).cast("bigint").alias(name), *[quoted(c) for c in df.columns]).where(F.lit(False))
    if len(wanted) <= BROADCAST_ROWS:
        asked = F.broadcast(asked)
    return rows.join(asked, name).select(quoted(order), *[quoted(c) for c in rows.columns]).orderBy(quoted(order))


def missing_rows(df: DataFrame, wanted: list[int], name: str = "Row") -> DataFrame:
    """(Row, total): the wanted positions that lie beyond the last row."""
    total = df.count()
    return df.sparkSession.createDataFrame(
        [(p, total) for p in dict.fromkeys(wanted) if p >= total], f"{name} bigint, total bigint"
    )


def rows(
    df: DataFrame,
    spec: str,
    order_by: list[str] | None = None,
    columns: str | None = None,
    numbered: bool = False,
    truncated: bool = False,
) -> DataFrame:
    """Rows of a table by a row spec, with the `Row` position; see parse_rows.

    `columns` projects, `numbered` names columns by position, `truncated` renders cells
    cut to their column's width.
    """
    chosen = parse_rows(spec)
    if isinstance(chosen, range):
        found = rows_between(df, chosen.start, chosen[-1], order_by)
    else:
        found = rows_at(df, chosen, order_by)
    extra = found.columns[: len(found.columns) - len(df.columns)]
    body = select_columns(found.drop(*extra), columns).columns
    out = found.select(*extra, *[quoted(c) for c in body])
    if numbered:
        out = out.toDF(*extra, *[str(i) for i in range(len(body))])
    return truncate_cells(out, keep=tuple(extra)) if truncated else out


def numbered_head(df: DataFrame, n: int = 5, order_by: list[str] | None = None) -> DataFrame:
    """`head` with columns named by position."""
    return number_columns(head(df, n, order_by))


# --- lines ---------------------------------------------------------------

LINE_ORDER = ["file", "line_no"]


def _wrapped(lines: DataFrame, width: int) -> DataFrame:
    """A text column soft-wrapped; width 0 leaves it raw."""
    return lines.withColumn("line", F.array_join(wrap_lines(F.col("line"), width), "\n")) if width else lines


def head_lines(lines: DataFrame, n: int = 5, width: int = 0, order_by: list[str] = LINE_ORDER) -> DataFrame:
    return _wrapped(head(lines, n, order_by), width)


def tail_lines(lines: DataFrame, n: int = 5, width: int = 0, order_by: list[str] = LINE_ORDER) -> DataFrame:
    return _wrapped(tail(lines, n, order_by), width)


def line_segment(lines: DataFrame, start: int, count: int, per: list[str] = ["file"]) -> DataFrame:
    """`count` lines from line `start` of every file, fewer at the end of one."""
    at = F.col("line_no")
    return lines.where((at >= start) & (at < start + count)).orderBy(*per, "line_no")


def missing_lines(lines: DataFrame, spec: str) -> DataFrame:
    """(file, line_no, lines): what a row spec asks of a file beyond its last line; of a range, only its start."""
    chosen = parse_rows(spec)
    wanted = [chosen.start] if isinstance(chosen, range) else list(dict.fromkeys(chosen))
    asked = F.from_json(F.lit(json.dumps(wanted)), "array<bigint>", {"mode": "FAILFAST"})
    sizes = lines.groupBy("file").agg((F.max("line_no") + 1).alias("lines"))
    beyond = F.filter(asked, lambda p: p >= F.col("lines"))
    return sizes.select("file", F.explode(beyond).alias("line_no"), "lines")


def rows_of_lines(lines: DataFrame, spec: str, width: int = 0) -> DataFrame:
    """Lines of every file by a row spec; lines a file does not have are left out, see `missing_lines`.

    A range that begins behind the last line of every file is an error.
    """
    chosen = parse_rows(spec)
    if isinstance(chosen, range):
        if lines.where(F.col("line_no") >= chosen.start).isEmpty():
            raise ValueError(f"start line {chosen.start} is out of range")
        found = lines.where(F.col("line_no").between(chosen.start, chosen[-1]))
    else:
        asked = lines.sparkSession.createDataFrame(list(enumerate(chosen)), "ord bigint, line_no bigint")
        if len(chosen) <= BROADCAST_ROWS:
            asked = F.broadcast(asked)
        found = lines.join(asked, "line_no")
    return _wrapped(found, width)
