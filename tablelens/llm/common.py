"""Helpers shared by the training-data operators.

Conventions of every operator here
- Only the named columns of the input are read, so extra columns, whatever they are called, do no harm.
- A null text counts as empty. Rows are never dropped because a column is null.
- Results of a phase that later phases read again are written to the shared folder
  (``spark.checkpoint.dir``), so a lost executor costs a re-run of tasks, never of whole phases.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.session import scratch_dir

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: ASCII white space and the letters A-Z, as the word rules of this package know them.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Stands for a null id; no real id is larger.
LAST_ID = (1 << 63) - 1


def kept(df: DataFrame, label: str) -> DataFrame:
    """`df` written once to the shared folder and read back; its shuffle files go at once."""
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Within it, a finished query's shuffle files are deleted instead of waiting for the garbage collector."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def crc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_ONES = [np.uint64((1 << (8 * k)) - 1) for k in range(8)] + [np.uint64(0xFFFFFFFFFFFFFFFF)]
_MASK = np.array(_ONES, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes, computed for all spans at once, eight bytes a step."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    words = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(data) + 1,), (1,))
    lengths = ends - starts
    out = mixed(lengths.astype(np.uint64) * _M1 + np.uint64(seed))
    todo, step = np.arange(len(starts)), 0
    while len(todo):
        left = lengths[todo] - step
        piece = words[starts[todo] + step] & _MASK[np.minimum(left, 8)]
        out[todo] = mixed((out[todo] ^ piece) * _M2 + _M3)
        step += 8
        todo = todo[left > 8]
    return out


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and the n + 1 offsets of its rows (null: empty)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, every other byte as it is."""
    return np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)


#: Bytes of words without punctuation: ASCII letters and digits, and all of any other alphabet.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words_of_rows(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray = ~_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends, and for each row the index of its first word (n + 1 entries).

    Rows lie back to back in `data`; a word is a run of `letters` (all but ASCII white space, unless
    given) and never reaches over the end of its row.
    """
    inside = np.empty(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = letters[data]
    first = inside[1:] & ~inside[:-1]  # at i: byte i begins a word
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[begins[inside[1:][begins]]] = True
    starts = np.flatnonzero(first)
    last = inside[1:-1] & ~inside[2:] if len(data) else np.zeros(0, bool)
    finals = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[finals[inside[1:-1][finals]]] = True
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Bytes of text that a Python worker handles at a time, but for a single longer text.
SLICE = 4 << 20


def slices(column, lower: bool = False, letters: np.ndarray = ~_SPACE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, word starts, word ends, first word of each row) of slices of rows.

    `lower`: A-Z lower-cased; `letters`: bytes that words are made of.
    """
    data, offsets = text_bytes(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1)
        part = data[offsets[at] : offsets[to]]
        part = lowered(part) if lower else part
        yield at, to, part, *words_of_rows(part, offsets[at : to + 1] - offsets[at], letters)
        at = to


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of `length` words; entry i is the run that begins at word i."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for k in range(1, length):
        out = out * _M1 + words[k : k + n]
    return mixed(out)


def window_places(first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers at which a window begins, and the row of each."""
    per = np.maximum(np.diff(first) - window + 1, 0)
    row = np.repeat(np.arange(len(per)), per)
    return np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per) + first[:-1][row], row
