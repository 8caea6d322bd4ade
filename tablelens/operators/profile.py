"""Column profiles: one output row per column of the input.

The quick profile is one scan with one aggregate. The full profile adds value
frequencies, from which mode, exact median, frequent words and extremes follow:

* numeric and string columns are counted in two separate shuffles, so each reads only
  its own columns and every parquet column is still read once;
* the counts are combined before the shuffle, so a value that fills a third of the table
  crosses the network once per map task;
* no per-group value maps (Spark's `median` and `mode` keep one) and no sort of the
  whole table: sketches enclose the middle rank, exact counts confirm it, and only a few
  values are ranked.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablelens.functions.columns import number_columns, quoted, select_columns
from tablelens.functions.numbers import finite_or_null, parse_any, parse_finite, render_double
from tablelens.functions.words import SPACE, bare_word, cn_chars, en_words, not_blank
from tablelens.session import SPREAD_BYTES, input_bytes, scratch_dir, spread

INFER_RATE = 0.9
#: Size of the sketches that enclose middle ranks; the steps of rank at which they are cut (three to
#: four times their error apart); how many values are ranked one by one.
SKETCH, STEPS, FEW = 4096, 1024, 4096
#: Input of a task up to which it counts all columns at once; in how many parts columns are dealt beyond it.
COUNT_BYTES, COUNT_PARTS = 32 * 1024 * 1024, 16
WORDS = "struct<en_words:bigint,cn_chars:bigint,total:bigint>"
CONTENT = "struct<content:string,n:bigint>"
PROFILE_SCHEMA = (
    "name string, dtype string, is_numeric boolean, is_inferred boolean, count bigint, "
    "none_count bigint, na_count bigint, zero_count bigint, non_zero_valid_count bigint, "
    "mean double, median double, mode string, std_dev double, variance double, "
    "skewness double, kurtosis double, min double, max double, "
    f"word_count {WORDS}, top_freq_word string, top_freq_content {CONTENT}, "
    "longest string, shortest string"
)


@dataclass(frozen=True)
class _Col:
    """A profiled column: its place, its name and how its values are read."""

    idx: int
    name: str
    dtype: str
    kind: str  # numeric, string, other


def _columns(df: DataFrame) -> list[_Col]:
    def kind(t: T.DataType) -> str:
        if isinstance(t, T.NumericType):
            return "numeric"
        return "string" if isinstance(t, (T.StringType, T.CharType, T.VarcharType)) else "other"

    return [
        _Col(i, f.name, f.dataType.simpleString(), kind(f.dataType)) for i, f in enumerate(df.schema)
    ]


def _distinct_names(df: DataFrame) -> DataFrame:
    """Columns chosen twice are told apart by position while they are profiled."""
    return number_columns(df)


# --- the one-scan statistics ---------------------------------------------


def _cells(df: DataFrame, cols: list[_Col]) -> DataFrame:
    """(idx, missing, d, s, v): one row per cell.

    Aggregating cells by column keeps the generated code as small for a thousand columns
    as for one; an aggregate with a dozen functions per column outgrows what the JVM
    compiles at about five columns.
    """
    none = F.lit(None)
    cells = [
        F.struct(
            F.lit(c.idx).alias("idx"),
            quoted(c.name).isNull().alias("missing"),
            (quoted(c.name) if c.kind == "numeric" else none).cast("double").alias("d"),
            (quoted(c.name) if c.kind == "string" else none).cast("string").alias("s"),
        )
        for c in cols
    ]
    number = finite_or_null(F.col("d"))
    if any(c.kind == "string" for c in cols):
        number = F.coalesce(number, parse_finite(F.col("s")))
    return spread(df).select(F.inline(F.array(*cells))).select("*", number.alias("v"))


def _one_pass(df: DataFrame, cols: list[_Col], full: bool, accuracy: int | None = None) -> DataFrame:
    """One row per column with all statistics that merge in a single pass, and the type decision.

    `accuracy` adds an approximate median to them.
    """
    v, s, none = F.col("v"), F.col("s"), F.lit(None).cast("double")
    stats = {
        "count": F.count(F.lit(1)),
        "none_count": F.count_if(F.col("missing")),
        "na_count": F.count_if(F.col("missing") | F.isnan("d") | (s.isNotNull() & v.isNull())),
        "filled": F.count_if(not_blank(s)),
        "valid": F.count(v),
        "zero_count": F.count_if(v == 0.0),
        "mean": F.avg(v),
        "min": F.min(v),
        "max": F.max(v),
        "variance": F.var_pop(v) if full else F.first(none),
        "skewness": F.skewness(v) if full else F.first(none),
        "kurtosis": F.kurtosis(v) if full else F.first(none),
    }
    if accuracy:
        stats["median"] = F.percentile_approx(v, 0.5, accuracy)
    found = _cells(df, cols).groupBy("idx").agg(*[c.alias(k) for k, c in stats.items()])
    known = df.sparkSession.createDataFrame(
        [(c.idx, c.kind, c.dtype) for c in cols], "idx int, kind string, dtype string"
    )
    # One row per column on both sides; a table without rows still lists its columns.
    rows = known.join(F.broadcast(found), "idx", "left").fillna(
        0, ["count", "none_count", "na_count", "filled", "valid", "zero_count"]
    )
    inferred = (
        (F.col("kind") == "string")
        & (F.col("filled") > 0)
        & (F.col("valid") / F.col("filled") >= INFER_RATE)
    )
    rows = rows.withColumn("is_inferred", F.coalesce(inferred, F.lit(False)))
    shown = (F.col("kind") == "numeric") | F.col("is_inferred")
    some = shown & (F.col("valid") > 0)

    def stat(name: str) -> Column:
        return F.when(some, F.col(name)).alias(name)

    # A constant column has no spread: both shape statistics are 0 there.
    def shape(name: str) -> Column:
        return F.when(some & F.lit(full), F.coalesce(F.nanvl(F.col(name), F.lit(None)), F.lit(0.0))).alias(name)

    zero = F.lit(0).cast("bigint")
    return rows.select(
        "idx",
        "dtype",
        shown.alias("is_numeric"),
        "is_inferred",
        "count",
        "none_count",
        F.when(shown, F.col("na_count")).otherwise(zero).alias("na_count"),
        F.when(shown, F.col("zero_count")).otherwise(zero).alias("zero_count"),
        F.when(shown, F.col("valid") - F.col("zero_count")).otherwise(zero).alias("non_zero_valid_count"),
        stat("mean"),
        F.when(some, F.sqrt("variance")).alias("std_dev"),
        stat("variance"),
        shape("skewness"),
        shape("kurtosis"),
        stat("min"),
        stat("max"),
        *([stat("median")] if accuracy else []),
    )


# --- value frequencies ---------------------------------------------------


def _slices(df: DataFrame) -> int:
    """In how many parts a task counts the values of its split, so that its table of counts stays small.

    A task reads a split, SPREAD_BYTES at most, or less if the cores outnumber such splits.
    """
    spark = df.sparkSession
    return math.ceil(min(input_bytes(df) / spark.sparkContext.defaultParallelism, SPREAD_BYTES) / COUNT_BYTES)


def _number_counts(df: DataFrame, cols: list[_Col]) -> DataFrame:
    """(idx, whole, v, n): how often each number occurs in each numeric column.

    Whole numbers keep their exact value in `whole` beside the double `v`. Of a large input a task counts
    a few columns and the values of one hash at a time; each part reads only its own columns.
    """

    def cells(some: list[_Col]) -> Column:
        out = []
        for c in some:
            t = df.schema[c.name].dataType
            whole = quoted(c.name).cast("bigint") if isinstance(t, T.IntegralType) else F.lit(None).cast("bigint")
            out.append(
                F.struct(F.lit(c.idx).alias("idx"), whole.alias("whole"), quoted(c.name).cast("double").alias("v"))
            )
        return F.inline(F.array(*out))

    mine = df.select(*[quoted(c.name) for c in cols])
    slices = _slices(mine)
    if slices <= 1:
        long = spread(mine).select(cells(cols)).where(F.col("v").isNotNull())
    else:
        width = math.ceil(len(cols) / COUNT_PARTS)
        parts = [mine.select(cells(cols[i : i + width])) for i in range(0, len(cols), width)]
        # Equal numbers have equal hashes, -0.0 and 0.0 too, so each is counted in one part.
        hashed = F.pmod(F.xxhash64(F.col("v") + 0.0), F.lit(slices))
        long = reduce(DataFrame.unionAll, [p.where(F.col("v").isNotNull() & (hashed == k)) for p in parts for k in range(slices)])
    return long.groupBy("idx", "whole", "v").agg(F.count(F.lit(1)).alias("n"))


def _text_counts(df: DataFrame, cols: list[_Col]) -> DataFrame:
    """(idx, s, n): how often each non-empty text occurs in each string column."""
    cells = [F.struct(F.lit(c.idx).alias("idx"), quoted(c.name).alias("s")) for c in cols]
    mine = df.select(*[quoted(c.name) for c in cols])
    long = spread(mine).select(F.inline(F.array(*cells))).where(F.col("s") != "")
    return long.groupBy("idx", "s").agg(F.count(F.lit(1)).alias("n"))


def _number_modes(counts: DataFrame) -> DataFrame:
    """(idx, mode): the most frequent number of each column, the smallest one on ties."""
    most = counts.groupBy("idx").agg(F.max("n").alias("n"))
    return (
        counts.join(F.broadcast(most), ["idx", "n"])  # one row per column
        .groupBy("idx")
        .agg(F.min("whole").alias("whole"), F.min("v").alias("v"))
        .select("idx", F.coalesce(F.col("whole").cast("string"), render_double(F.col("v"))).alias("mode"))
    )


@dataclass(frozen=True)
class _Stretch:
    """The open interval of values that holds a column's middle ranks, and where to cut it next.

    `before` values lie at or below `low`; `few`: what is left can be ranked one by one.
    """

    low: float
    high: float
    before: int
    cut: tuple[float, float]
    few: bool = False


def exact_medians(df: DataFrame, values: dict[int, Column], valid: dict[int, int]) -> dict[int, float]:
    """The median of each column of numbers, from scans that send a few numbers per column and task.

    `values` are the columns (usable numbers or null) and `valid` how many numbers each has. A
    mergeable sketch names two values that enclose the middle ranks; the next scan counts exactly
    what lies below, between and at them, and sketches what lies between. That is a small share of
    the column however its values are spread, so each scan leaves about three in a thousand of what
    the one before left, until at most FEW values remain, which are ranked one by one. A sketch
    that errs costs another scan, never a wrong median. Values that many rows share are counted at
    the cuts, so they do not fill the remainder. Columns without numbers are left out.
    """
    ranks = {i: sorted({(n + 1) // 2, n // 2 + 1}) for i, n in valid.items() if n and i in values}
    found: dict[int, dict[int, float]] = {i: {} for i in ranks}
    cuts = _first_cuts(df, {i: values[i] for i in ranks})
    open_ = {i: _Stretch(-math.inf, math.inf, 0, c) for i, c in cuts.items()}
    while open_:
        counted = _counted(df, {i: values[i] for i in open_}, open_)
        for i, at in list(open_.items()):
            todo = [r for r in ranks[i] if r not in found[i]]
            rest = None
            for r in todo:
                value, stretch = _locate(counted[i], at, r)
                if stretch is None:
                    found[i][r] = value
                rest = rest or stretch
            if rest is None:
                del open_[i]
            else:
                open_[i] = rest
    # Halved before adding, so that two huge values do not overflow; + 0.0 turns -0.0 into 0.0.
    return {i: (v[min(v)] if len(v) == 1 else v[min(v)] / 2 + v[max(v)] / 2) + 0.0 for i, v in found.items()}


def _first_cuts(df: DataFrame, values: dict[int, Column]) -> dict[int, tuple[float, float]]:
    """Two values of each column that most likely enclose its middle ranks."""
    if not values:
        return {}
    sketches = df.agg(*[F.kll_sketch_agg_double(v, F.lit(SKETCH)).alias(f"s{i}") for i, v in values.items()])
    row = sketches.select(
        *[F.kll_sketch_get_quantile_double(f"s{i}", F.lit(0.5 + d / STEPS)).alias(f"{n}{i}") for i in values for n, d in (("l", -1), ("h", 1))]
    ).first()
    return {i: (row[f"l{i}"], row[f"h{i}"]) for i in values}


def _counted(df: DataFrame, values: dict[int, Column], open_: dict[int, _Stretch]) -> dict[int, dict]:
    """What lies below, at, between and above the cuts of each stretch; all values of a stretch of few.

    Counts and extremes are grouped by column and part over one row per cell, which the JVM compiles;
    lists and sketches see only the rows that hold a value they take.
    """
    few = {i: v for i, v in values.items() if open_[i].few}
    more = {i: v for i, v in values.items() if not open_[i].few}
    found: dict[int, dict] = {}
    if few:
        inner = {i: (v > open_[i].low) & (v < open_[i].high) for i, v in few.items()}
        lists = [F.sort_array(F.collect_list(F.when(inner[i], v))).alias(str(i)) for i, v in few.items()]
        row = df.where(reduce(Column.__or__, inner.values())).agg(*lists).first()
        found |= {i: {"all": row[str(i)]} for i in few}
    if more:
        # The cuts go along as fields, so that one short expression tells the part of every column's cells.
        cells = []
        for i, v in more.items():
            at, (left, right) = open_[i], open_[i].cut
            bounds = {"low": at.low, "left": left, "right": right, "high": at.high}
            cells.append(F.struct(F.lit(i).alias("idx"), v.alias("v"), *[F.lit(float(b)).alias(k) for k, b in bounds.items()]))
        v, left, right = F.col("v"), F.col("left"), F.col("right")
        names = ["below", "left", "between", "right", "above"]
        place = F.when(v < left, 0).when(v == left, 1).when(v < right, 2).when(v == right, 3).otherwise(4)
        parts = df.select(F.inline(F.array(*cells))).where((v > F.col("low")) & (v < F.col("high")))
        rows = parts.groupBy("idx", place.alias("part")).agg(F.count("v").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        for i in more:
            found[i] = {n: 0 for n in names} | {f"{n}_{x}": None for n in names for x in ("min", "max")}
        for r in rows.collect():  # five rows per column at most
            name = names[r.part]
            found[r.idx] |= {name: r.n, f"{name}_min": r.least, f"{name}_max": r.most}
        many = {i: v for i, v in more.items() if found[i]["between"] > FEW}
        for i, steps in _steps(df, many, open_).items():
            found[i]["steps"] = steps
    return found


def _steps(df: DataFrame, values: dict[int, Column], open_: dict[int, _Stretch]) -> dict[int, list[float]]:
    """The values between each column's cuts at equal steps of rank, by a sketch of them."""
    if not values:
        return {}
    between = {i: (v > open_[i].cut[0]) & (v < open_[i].cut[1]) for i, v in values.items()}
    sketches = [F.kll_sketch_agg_double(F.when(between[i], v), F.lit(SKETCH)).alias(f"s{i}") for i, v in values.items()]
    ranks = F.array(*[F.lit(k / STEPS) for k in range(STEPS + 1)])
    row = df.where(reduce(Column.__or__, between.values())).agg(*sketches).select(
        *[F.kll_sketch_get_quantile_double(f"s{i}", ranks).alias(str(i)) for i in values]
    ).first()
    return {i: row[str(i)] for i in values}


def _locate(c: dict, at: _Stretch, rank: int) -> tuple[float | None, _Stretch | None]:
    """The value of a rank, or the smaller stretch that holds it."""
    before = at.before
    if at.few:
        return c["all"][rank - before - 1], None
    left, right = at.cut
    parts = [
        (c["below"], c["below_min"], c["below_max"], at.low, left, (c["below_min"], c["below_max"])),
        (c["left"], left, left, left, left, None),
        (c["between"], c["between_min"], c["between_max"], left, right, None),
        (c["right"], right, right, right, right, None),
        (c["above"], c["above_min"], c["above_max"], right, at.high, (c["above_min"], c["above_max"])),
    ]
    for n, least, most, low, high, cut in parts:
        if rank <= before + n:
            if rank == before + 1 or least == most:
                return least, None
            if rank == before + n:
                return most, None
            if cut is None and n > FEW:  # the steps of the sketch beside the rank
                at_step = (rank - before) * STEPS // n
                cut = c["steps"][max(at_step - 1, 0)], c["steps"][min(at_step + 2, STEPS)]
            return None, _Stretch(low, high, before, cut or (least, most), n <= FEW)
        before += n
    raise ValueError("the table changed while its median was sought")


def _text_blocks(counts: DataFrame) -> DataFrame:
    """Per string column: word counts, most frequent content, longest and shortest value."""
    s, n = F.col("s"), F.col("n")
    en, cn = F.sum(en_words(s) * n), F.sum(cn_chars(s) * n)
    top = F.min_by(F.struct(s.alias("content"), n.alias("n")), F.struct(-n, s))
    return counts.groupBy("idx").agg(
        F.struct(en.alias("en_words"), cn.alias("cn_chars"), (en + cn).alias("total")).alias("word_count"),
        top.alias("top_freq_content"),
        F.min_by(s, F.struct(-F.octet_length(s), s)).alias("longest"),
        F.min_by(s, F.struct(F.octet_length(s), s)).alias("shortest"),
    )


def top_words(counts: DataFrame, by: str = "idx") -> DataFrame:
    """The most frequent bare word per `by` of weighted texts (by, s, n); smallest on ties."""
    # Words are counted as they stand first, so only different words have to be cleaned.
    raw = (
        counts.select(by, F.explode(F.split("s", f"{SPACE}+")).alias("word"), "n")
        .groupBy(by, "word")
        .agg(F.sum("n").alias("n"))
    )
    found = (
        raw.select(by, bare_word(F.col("word")).alias("word"), "n")
        .where(F.col("word") != "")
        .groupBy(by, "word")
        .agg(F.sum("n").alias("n"))
    )
    best = F.min_by(F.struct("word", "n"), F.struct(-F.col("n"), F.col("word")))
    return found.groupBy(by).agg(best.alias("w")).select(by, "w.word", "w.n")


# --- profiles ------------------------------------------------------------


def profile(
    df: DataFrame,
    full: bool = True,
    columns: str | None = None,
    numbered: bool = False,
    median_accuracy: int | None = None,
) -> DataFrame:
    """Profile every column: one row per column, schema PROFILE_SCHEMA.

    `columns` is a column spec (see parse_columns), `numbered` shows positions instead of
    names. Quick profiles leave the full-only fields null. A full profile first runs the
    one-scan statistics and takes its one row per column to the driver, because which
    string columns hold numbers decides what the frequency passes have to do.
    `median_accuracy` trades the exact median for `percentile_approx` in the one scan.
    """
    df = select_columns(df, columns)
    names = [str(i) for i in range(len(df.columns))] if numbered else df.columns
    df = _distinct_names(df)
    cols = _columns(df)
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("idx") + 1).alias("name")
    stats = _one_pass(df, cols, full, median_accuracy if full else None)
    if not full:
        return _as_profile(stats.select("*", label))

    spark = df.sparkSession
    known = stats.collect()  # one row per column
    stats = spark.createDataFrame(known, stats.schema)
    inferred = {r.idx for r in known if r.is_inferred}
    numbers = [c for c in cols if c.kind == "numeric"]
    texts = [c for c in cols if c.kind == "string"]
    out = stats.select("*", label)
    if numbers:
        counts = _number_counts(df, numbers)
        out = out.join(F.broadcast(_number_modes(counts)), "idx", "left")
    if texts:
        counts = _text_counts(df, texts)
        out = out.join(F.broadcast(_text_blocks(counts)), "idx", "left")
        worded = counts
        if inferred:  # columns of numbers have no words
            worded = counts.withColumn("s", F.when(~F.col("idx").isin(sorted(inferred)), F.col("s")))
        out = out.join(
            F.broadcast(top_words(worded).select("idx", F.col("word").alias("top_freq_word"))), "idx", "left"
        )
    if not median_accuracy:
        valid = {r.idx: r.zero_count + r.non_zero_valid_count for r in known if r.min is not None}
        values = {c.idx: finite_or_null(quoted(c.name).cast("double")) for c in numbers}
        found = exact_medians(df, values, valid)
        if inferred:  # texts are parsed once, not in every scan
            parsed = [c for c in texts if c.idx in inferred]
            path = scratch_dir(spark, "numbers")
            mine = spread(df.select(*[quoted(c.name) for c in parsed]))
            mine.select(*[parse_finite(quoted(c.name)).alias(c.name) for c in parsed]).write.parquet(path)
            found |= exact_medians(spark.read.parquet(path), {c.idx: quoted(c.name) for c in parsed}, valid)
        medians = spark.createDataFrame(list(found.items()), "idx int, median double")  # one row per column
        out = out.join(F.broadcast(medians), "idx", "left")
    have = set(out.columns)
    content_mode = F.col("top_freq_content.content") if "top_freq_content" in have else F.lit(None)
    number_mode = F.col("mode") if "mode" in have else F.lit(None)
    out = out.withColumn("mode", F.coalesce(number_mode, content_mode))
    for name in ("word_count", "top_freq_content", "top_freq_word", "longest", "shortest"):
        if name in have:  # text statistics describe text columns only
            out = out.withColumn(name, F.when(~F.col("is_numeric"), F.col(name)))
    return _as_profile(out)


def _as_profile(rows: DataFrame) -> DataFrame:
    """Bring rows to the profile schema, missing fields as nulls."""
    want = T.StructType.fromDDL(PROFILE_SCHEMA)
    return rows.select(
        *[
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in want
        ]
    )


def quick_profile(df: DataFrame, columns: str | None = None, numbered: bool = False) -> DataFrame:
    return profile(df, full=False, columns=columns, numbered=numbered)


def shape(df: DataFrame) -> DataFrame:
    """(rows, columns) of a table."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)).cast("bigint"))


def column_modes(df: DataFrame) -> DataFrame:
    """(name, mode, n) of every numeric and string column."""
    names = F.array(*[F.lit(n) for n in df.columns])
    flat = _distinct_names(df)
    cols = _columns(flat)
    out = []
    numbers = [c for c in cols if c.kind == "numeric"]
    texts = [c for c in cols if c.kind == "string"]
    if numbers:
        counts = _number_counts(flat, numbers)
        most = counts.groupBy("idx").agg(F.max("n").alias("n"))
        out.append(_number_modes(counts).join(F.broadcast(most), "idx").select("idx", "mode", "n"))
    if texts:
        best = F.min_by(F.struct("s", "n"), F.struct(-F.col("n"), F.col("s")))
        out.append(
            _text_counts(flat, texts).groupBy("idx").agg(best.alias("b")).select("idx", "b.s", "b.n")
        )
    rows = out[0].toDF("idx", "mode", "n")
    for more in out[1:]:
        rows = rows.unionAll(more.toDF("idx", "mode", "n"))
    return rows.select(F.element_at(names, F.col("idx") + 1).alias("name"), "mode", "n")


# --- reports over all-string records -------------------------------------

REPORT_FIELDS = ("name", "type", "total", "non_empty")
SUMMARY_FIELDS = ("name", "type", "non_empty", "mean", "min", "max", "zero_count", "en_words", "cn_chars")


def string_stats(df: DataFrame, names: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, name, statistics): one row per column of all-string records.

    Works on streams too; `by` names grouping columns, such as a window.
    """
    by = by or []
    cells = [F.struct(F.lit(n).alias("name"), quoted(n).cast("string").alias("c")) for n in names]
    c, number = F.col("c"), F.col("v")
    filled = F.when(c != "", c)
    long = df.select(*[F.col(b) for b in by], F.inline(F.array(*cells))).select("*", parse_any(filled).alias("v"))
    # Extremes are those of real numbers; Spark would take NaN for the largest.
    ordered = F.when(~F.isnan(number), number)
    stats = {
        "total": F.count(c),
        "non_empty": F.count(filled),
        "parsed": F.count(number),
        "mean": F.avg(number),
        "min": F.min(ordered),
        "max": F.max(ordered),
        "zero_count": F.count_if(number == 0.0),
        "en_words": F.coalesce(F.sum(en_words(c)), F.lit(0)),
        "cn_chars": F.coalesce(F.sum(cn_chars(c)), F.lit(0)),
    }
    return long.groupBy(*by, "name").agg(*[s.alias(k) for k, s in stats.items()])


def with_string_type(rows: DataFrame) -> DataFrame:
    """Decide empty, numeric or string per row of string_stats and blank out what does not apply."""
    numeric = (F.col("non_empty") > 0) & (F.col("parsed") / F.col("non_empty") > INFER_RATE)
    rows = rows.withColumn(
        "type", F.when(F.col("non_empty") == 0, "empty").when(numeric, "numeric").otherwise("string")
    )
    for stat in ("mean", "min", "max", "zero_count"):
        rows = rows.withColumn(stat, F.when(F.col("type") == "numeric", F.col(stat)))
    for stat in ("en_words", "cn_chars"):
        rows = rows.withColumn(stat, F.when(F.col("type") != "numeric", F.col(stat)))
    return rows


def summary_type(rows: DataFrame) -> DataFrame:
    """The summary tells numeric columns from all others only."""
    shown = F.when(F.col("type") == "numeric", "numeric").otherwise("string")
    return rows.withColumn("type", shown)


def _all_columns(df: DataFrame) -> DataFrame:
    """string_stats with every column listed, also when there are no records."""
    known = df.sparkSession.createDataFrame([(n,) for n in df.columns], "name string")
    found = string_stats(df, df.columns)  # one row per column
    counts = ["total", "non_empty", "parsed", "zero_count", "en_words", "cn_chars"]
    return known.join(F.broadcast(found), "name", "left").fillna(0, counts)


def string_report(df: DataFrame, columns: str | None = None) -> DataFrame:
    """Type report of an all-string table: empty, numeric (more than 0.9 parse) or string."""
    return with_string_type(_all_columns(select_columns(df, columns))).select(*REPORT_FIELDS)


def string_summary(df: DataFrame, columns: str | None = None) -> DataFrame:
    """Summary of an all-string table; word counts for columns that are not numeric."""
    rows = with_string_type(_all_columns(select_columns(df, columns)))
    return summary_type(rows).select(*SUMMARY_FIELDS)
