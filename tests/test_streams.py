import datetime as dt
import os

from pyspark.sql import functions as F

from tablelens.operators import profile as P
from tablelens.streaming import running as X

ROWS = [(str(i), "" if i % 3 else "word", "a" if i % 4 else "b") for i in range(40)]


def folder(spark, tmp_path, parts=4):
    """CSV files that arrive one per micro-batch."""
    path = str(tmp_path / "in")
    df = spark.createDataFrame(ROWS, "n string, w string, k string")
    df.repartition(parts).write.csv(path)
    return df, X.stream_records(spark, path, df.schema, files_per_batch=1)


def run(stream, tmp_path, mode):
    out = str(tmp_path / "out")
    X.write_batches(stream, out, str(tmp_path / "state"), mode).awaitTermination()
    return out


def test_running_summary_equals_the_batch_one(spark, tmp_path):
    df, stream = folder(spark, tmp_path)
    got = X.read_latest(spark, run(X.running_summary(stream), tmp_path, "complete"))
    want = P.string_summary(df.select(*[F.nullif(c, F.lit("")).alias(c) for c in df.columns]))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_top_values_over_batches(spark, tmp_path):
    df, stream = folder(spark, tmp_path)
    out = str(tmp_path / "counts")
    X.count_values(stream, ["w", "k"], out, str(tmp_path / "state")).awaitTermination()
    assert X._finished(spark, out) == {(i, i) for i in range(4)}
    got = {r.name: (r.content, r.n) for r in X.top_values(spark, out).collect()}
    assert got == {"w": ("word", 14), "k": ("a", 30)}
    assert X.top_values(spark, str(tmp_path / "nothing")).collect() == []


def test_counts_are_added_up_in_levels(spark, tmp_path):
    """Read cost does not grow with the batches; cut off sums and repeated batches change nothing."""
    df, stream = folder(spark, tmp_path, parts=11)
    out = str(tmp_path / "counts")
    X.count_values(stream, ["w", "k", "n"], out, str(tmp_path / "state"), fanout=3).awaitTermination()
    finished = X._finished(spark, out)
    last = max(b for _, b in finished)
    assert last == 10 and X._cover(finished, 0, last) == [(0, 8), (9, 9), (10, 10)]
    assert (0, 0) not in finished and (0, 2) in finished  # only tables whose sums are old enough are gone
    want = {"w": ("word", 14), "k": ("a", 30), "n": ("0", 1)}
    tops = lambda: {r.name: (r.content, r.n) for r in X.top_values(spark, out).collect()}
    assert tops() == want
    os.remove(f"{out}/0-8/{X.MARK}")  # a sum that was cut off: its parts are still there
    assert X._cover(X._finished(spark, out), 0, last)[-2:] == [(9, 9), (10, 10)] and tops() == want
    X._add_up(spark, out, 8, 3)
    assert (0, 8) in X._finished(spark, out) and tops() == want
    again = spark.read.parquet(f"{out}/10-10").collect()
    X._save(spark.createDataFrame(again), out, 10, 10)
    X._add_up(spark, out, 10, 3)
    assert tops() == want


def test_missing_counts_are_an_error():
    try:
        X._cover({(0, 2), (4, 4)}, 0, 4)
    except ValueError as e:
        assert "batch 3" in str(e)
    else:
        raise AssertionError


def test_running_words(spark, tmp_path):
    (tmp_path / "t").mkdir()
    for i in range(3):
        (tmp_path / "t" / f"{i}.txt").write_text(f"two words\r\n中文 {i}\n")
    stream = X.stream_lines(spark, str(tmp_path / "t"))
    got = X.read_latest(spark, run(X.running_words(stream), tmp_path, "complete")).first()
    assert tuple(got) == (6, 9, 6, 15)


def test_first_rows(spark, tmp_path):
    _, stream = folder(spark, tmp_path, parts=2)
    assert X.read_appended(spark, run(X.first_rows(stream, 5), tmp_path, "append")).count() == 5


def test_windows_and_late_rows(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)

    def at(minutes, v):
        return (start + dt.timedelta(minutes=minutes), v)

    batches = [[at(1, "1"), at(5, "3")], [at(31, "5")], [at(62, "7")], [at(2, "100"), at(70, "8")], [at(95, "9")]]
    path = tmp_path / "in"
    path.mkdir()
    for i, rows in enumerate(batches):  # one file per batch, oldest first
        text = "".join(f"{t.isoformat()},{v}\n" for t, v in rows)
        (path / f"{i}.csv").write_text(text)
        os.utime(path / f"{i}.csv", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = X.stream_records(spark, str(path), "ts timestamp, v string", files_per_batch=1)
    out = run(X.windowed_summary(stream, "ts", "10 minutes", "10 minutes"), tmp_path, "append")
    got = {r.window_start.minute + 60 * (r.window_start.hour % 24): (r.non_empty, r.mean) for r in X.read_appended(spark, out).where("name = 'v'").collect()}
    assert got[0] == (2, 2.0)  # the row of value 100 came after its window was closed
    assert got[30] == (1, 5.0)
