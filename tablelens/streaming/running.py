"""Profiles of arriving data: the statistics that can be kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from tablelens.functions.columns import quoted
from tablelens.functions.words import cn_chars, en_words
from tablelens.operators.profile import SUMMARY_FIELDS, string_stats, summary_type, with_string_type
from tablelens.sources.formats import without_cr


def stream_records(
    spark: SparkSession, path: str, schema: T.StructType | str, format: str = "csv", files_per_batch: int | None = None, **options
) -> DataFrame:
    """Records of files as they arrive below a path."""
    reader = spark.readStream.schema(schema).format(format).options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line): text lines of files as they arrive."""
    lines = spark.readStream.text(path, lineSep="\n")
    return lines.select(without_cr(F.col("value")).alias("line"))


def running_summary(stream: DataFrame) -> DataFrame:
    """string_summary of all records so far; for output mode complete or update."""
    rows = with_string_type(string_stats(stream, stream.columns))
    return summary_type(rows).select(*SUMMARY_FIELDS)


def windowed_summary(stream: DataFrame, time: str, width: str, delay: str) -> DataFrame:
    """string_summary per event-time window; for output mode append.

    A window comes out once the watermark, `delay` behind the latest time seen, has passed
    its end. Rows that arrive later than that are left out.
    """
    names = [c for c in stream.columns if c != time]
    windowed = stream.withWatermark(time, delay).withColumn("w", F.window(time, width))
    rows = summary_type(with_string_type(string_stats(windowed, names, by=["w"])))
    return rows.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *SUMMARY_FIELDS
    )


def running_words(stream: DataFrame, text: str = "line") -> DataFrame:
    """Word counts of all lines so far, one row."""
    t = quoted(text)
    en, cn = F.coalesce(F.sum(en_words(t)), F.lit(0)), F.coalesce(F.sum(cn_chars(t)), F.lit(0))
    return stream.agg(
        F.count(F.lit(1)).alias("lines"), en.alias("en_words"), cn.alias("cn_chars"), (en + cn).alias("total")
    )


def first_rows(stream: DataFrame, n: int = 5) -> DataFrame:
    """The first n records to arrive; for output mode append."""
    return stream.limit(n)


# --- sinks ---------------------------------------------------------------


def write_batches(
    df: DataFrame, folder: str, checkpoint: str, mode: str = "append", available_now: bool = True
) -> StreamingQuery:
    """Write every micro-batch to its own sub-folder; a repeated batch replaces itself."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(save)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_appended(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of an appending query."""
    return spark.read.parquet(folder).drop("batch")


def read_latest(spark: SparkSession, folder: str) -> DataFrame:
    """The newest state of a query in complete mode."""
    states = spark.read.parquet(folder)
    newest = states.agg(F.max("batch")).first()[0]
    return states.where(F.col("batch") == newest).drop("batch")


#: Tables of counts that are added up into one, and the file that marks a complete one.
FANOUT, MARK = 8, "_COUNTED"


def count_values(
    stream: DataFrame, columns: list[str], folder: str, checkpoint: str, available_now: bool = True, fanout: int = FANOUT
) -> StreamingQuery:
    """Keep value counts of string columns in tables of partial counts below `folder`, without streaming state.

    Each micro-batch adds a table of its own. `fanout` tables of neighbouring batches are added up
    into one, as many of those into one, and so on, so however old the stream is, a reader opens
    fewer than `fanout` tables of each of log(batches) sizes, and a count is rewritten log(batches)
    times. A repeated batch replaces its table and finds finished sums as they are; a sum that was
    cut off has no mark and is made anew. Tables that went into a sum stay for `fanout`
    more batches, for readers that have opened them.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        cells = [F.struct(F.lit(c).alias("name"), quoted(c).cast("string").alias("value")) for c in columns]
        long = batch.select(F.inline(F.array(*cells))).where(F.col("value") != "")
        counts = long.groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
        _save(counts, folder, batch_id, batch_id)
        _add_up(batch.sparkSession, folder, batch_id, fanout)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _path(spark: SparkSession, name: str):
    """(path, file system) of a name, wherever it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _save(counts: DataFrame, folder: str, first: int, last: int) -> None:
    """Write a table of counts; the mark that it is complete comes last."""
    name = f"{folder}/{first}-{last}"
    counts.write.mode("overwrite").parquet(name)
    mark, fs = _path(counts.sparkSession, f"{name}/{MARK}")
    fs.create(mark).close()


def _finished(spark: SparkSession, folder: str) -> set[tuple[int, int]]:
    """(first, last) batch of each complete table of counts."""
    path, fs = _path(spark, folder)
    if not fs.exists(path):
        return set()
    names = [f.getPath().getName() for f in fs.listStatus(path)]
    return {tuple(int(x) for x in n.split("-")) for n in names if fs.exists(_path(spark, f"{folder}/{n}/{MARK}")[0])}


def _cover(finished: set[tuple[int, int]], first: int, last: int) -> list[tuple[int, int]]:
    """The fewest of the tables that hold each batch from first to last once."""
    out = []
    while first <= last:
        ends = [b for a, b in finished if a == first and b <= last]
        if not ends:
            raise ValueError(f"the counts of batch {first} are missing")
        out.append((first, max(ends)))
        first = max(ends) + 1
    return out


def _summed(spark: SparkSession, folder: str, tables: list[tuple[int, int]]) -> DataFrame:
    parts = spark.read.schema("name string, value string, n bigint").parquet(*[f"{folder}/{a}-{b}" for a, b in tables])
    return parts.groupBy("name", "value").agg(F.sum("n").alias("n"))


def _add_up(spark: SparkSession, folder: str, last: int, fanout: int) -> None:
    """Make the sums that end with batch `last`, and remove tables that went into one `fanout` batches ago."""
    width = fanout
    while (last + 1) % width == 0:
        span = last + 1 - width, last
        finished = _finished(spark, folder)
        if span not in finished:
            parts = _cover(finished, *span)
            _save(_summed(spark, folder, parts), folder, *span)
        width *= fanout
    finished = _finished(spark, folder)
    for a, b in finished:
        if any(c <= a and b <= d <= last - fanout and (c, d) != (a, b) for c, d in finished):
            old, fs = _path(spark, f"{folder}/{a}-{b}")
            fs.delete(old, True)


def top_values(spark: SparkSession, folder: str) -> DataFrame:
    """(name, content, n): the most frequent value per column so far, the smallest on ties; no rows before the first batch."""
    finished = _finished(spark, folder)
    if not finished:
        return spark.createDataFrame([], "name string, content string, n bigint")
    total = _summed(spark, folder, _cover(finished, 0, max(b for _, b in finished)))
    best = F.min_by(F.struct("value", "n"), F.struct(-F.col("n"), F.col("value")))
    return total.groupBy("name").agg(best.alias("b")).select("name", F.col("b.value").alias("content"), "b.n")
