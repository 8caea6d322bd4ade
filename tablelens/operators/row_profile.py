"""Row profiles: one output row per input row, from array expressions, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablelens.functions.columns import cell_text, quoted, select_columns
from tablelens.functions.numbers import finite_or_null, parse_any
from tablelens.functions.words import split_words, word_count
from tablelens.operators.positions import head, with_position
from tablelens.session import spread


def _number(df: DataFrame, name: str) -> Column:
    """A cell as a double, null when it does not parse; NaN and infinities do parse."""
    t = df.schema[name].dataType
    if isinstance(t, T.NumericType):
        return quoted(name).cast("double")
    if isinstance(t, T.StringType):
        return parse_any(quoted(name))
    return F.lit(None).cast("double")


def _top_content(cells: Column) -> Column:
    """struct<content, n> of the most frequent non-empty text; the smallest one on ties.

    Equal texts are neighbours once sorted, so one fold over the run lengths finds it.
    """
    start = F.struct(
        F.lit(None).cast("string").alias("cur"),
        F.lit(0).cast("bigint").alias("run"),
        F.lit(None).cast("string").alias("best"),
        F.lit(0).cast("bigint").alias("n"),
    )

    def step(acc: Column, x: Column) -> Column:
        run = F.when(acc["cur"].eqNullSafe(x), acc["run"] + 1).otherwise(F.lit(1).cast("bigint"))
        better = run > acc["n"]
        return F.struct(
            x.alias("cur"),
            run.alias("run"),
            F.when(better, x).otherwise(acc["best"]).alias("best"),
            F.when(better, run).otherwise(acc["n"]).alias("n"),
        )

    texts = F.array_sort(F.filter(cells, lambda x: x != ""))
    return F.aggregate(
        texts,
        start,
        step,
        lambda acc: F.when(
            acc["best"].isNotNull(), F.struct(acc["best"].alias("content"), acc["n"].alias("n"))
        ),
    )


def _sum(values: Column, f=lambda x: x) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + f(x))


def _power_mean(power: int) -> Column:
    def deviation(x: Column) -> Column:
        d = x - F.col("mean")
        out = d
        for _ in range(power - 1):
            out = out * d
        return out

    return _sum(F.col("__nums"), deviation) / F.col("__n")


def row_profile(
    df: DataFrame,
    columns: str | None = None,
    name_column: str | None = None,
    name_in_values: bool = True,
    order_by: list[str] | None = None,
) -> DataFrame:
    """Profile every row.

    A row is numeric when all its cells parse; its statistics cover the finite ones. Rows
    are named by `name_column`, or by position (see positions.with_position).
    `name_in_values=False` leaves the name cell out of the values.
    """
    cells = select_columns(df, columns).columns
    if name_column is None:
        df, label = with_position(df, order_by, name="__row"), F.col("__row")
    else:
        label = quoted(name_column)
        cells = [c for c in cells if name_in_values or c != name_column]
    base = spread(df).select(
        label.cast("string").alias("name"),
        F.array(*[cell_text(df, c) for c in cells]).alias("__cells"),
        F.array(*[_number(df, c) for c in cells]).alias("__parsed"),
    )
    numeric = F.forall("__parsed", lambda x: x.isNotNull())
    base = base.withColumn("is_numeric", numeric).withColumn(
        "__nums",
        F.when(F.col("is_numeric"), F.array_sort(F.filter("__parsed", lambda x: finite_or_null(x).isNotNull())))
        .otherwise(F.array().cast("array<double>")),
    )
    base = base.withColumn("__n", F.nullif(F.array_size("__nums"), F.lit(0)))
    nums, n = F.col("__nums"), F.col("__n")
    base = base.withColumn("mean", _sum(nums) / n)
    base = base.withColumn("variance", _power_mean(2)).withColumn("std_dev", F.sqrt("variance"))
    sd, var = F.col("std_dev"), F.col("variance")
    low, high = ((n + 1) / 2).cast("int"), (n / 2 + 1).cast("int")
    flat = F.when(n.isNotNull(), F.lit(0.0))
    zero = F.lit(0).cast("bigint")
    return base.select(
        "name",
        F.when(F.col("is_numeric"), "numeric").otherwise("str").alias("dtype"),
        "is_numeric",
        F.array_size("__cells").cast("bigint").alias("count"),
        "mean",
        F.when(n.isNotNull(), (F.get(nums, low - 1) + F.get(nums, high - 1)) / 2).alias("median"),
        "std_dev",
        "variance",
        F.when(sd > 0, _power_mean(3) / (sd * sd * sd)).otherwise(flat).alias("skewness"),
        F.when(var > 0, _power_mean(4) / (var * var) - 3.0).otherwise(flat).alias("kurtosis"),
        F.array_min(nums).alias("min"),
        F.array_max(nums).alias("max"),
        F.coalesce(F.array_size(F.filter(nums, lambda x: x == 0.0)).cast("bigint"), zero).alias("zero_count"),
        F.coalesce(F.array_size(F.filter(nums, lambda x: x != 0.0)).cast("bigint"), zero).alias("non_zero_valid_count"),
        word_count(F.array_join("__cells", " ")).alias("word_count"),
        _top_content(F.col("__cells")).alias("top_freq_content"),
    )


def row_fields(df: DataFrame, n: int = 20, order_by: list[str] | None = None) -> DataFrame:
    """(Row, fields, words) of the first n records of an all-string table."""
    first = head(df, n, order_by)
    words = F.lit(0)
    for c in df.columns:
        words = words + F.coalesce(F.array_size(split_words(quoted(c).cast("string"))), F.lit(0))
    return with_rank(first, order_by).select(
        "Row", F.lit(len(df.columns)).cast("bigint").alias("fields"), words.cast("bigint").alias("words")
    )


def record_fields(records: DataFrame, n: int = 20) -> DataFrame:
    """(file, record, fields, words) of the first n records of each file, each with its own number of fields; see `read_ragged`."""
    words = F.aggregate(F.transform("fields", lambda c: F.array_size(split_words(c))), F.lit(0), lambda a, x: a + x)
    first = records.where(F.col("record") < n)
    return first.select("file", "record", F.array_size("fields").cast("bigint").alias("fields"), words.cast("bigint").alias("words"))


def with_rank(few: DataFrame, order_by: list[str] | None) -> DataFrame:
    """Number the rows of a frame that a limit has already cut to a handful."""
    from pyspark.sql import Window

    if order_by is None:
        return few.withColumn("Row", F.monotonically_increasing_id())
    order = Window.orderBy(*[quoted(k) for k in order_by])
    return few.withColumn("Row", (F.row_number().over(order) - 1).cast("bigint"))
