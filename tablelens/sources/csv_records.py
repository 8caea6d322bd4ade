"""CSV records whose quoted fields hold line ends, read in splits.

A line is a step of an automaton with two states, inside a quoted field or not. Every block of a file is
read once for both states it may begin in; its effect is one of four functions of that state. The functions
are composed over the blocks of a file, which tells each block's true first state, and with it where
records begin. Records that lie in one block then come from a plain read; those that run over the end of
a block are put together from their pieces. So a file is read by as many tasks as it has splits, and only
pieces of records are shuffled.

A quote opens a field only at the field's begin, so inch marks inside a field are plain characters. A quoted
field that is never closed reaches to the end of its file, whose rest is then one record.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablelens.session import BROADCAST_BLOCKS, scratch_dir

# What is left of a quoted field, up to the quote that ends it; two quotes stand for one.
_TO_CLOSE = re.compile(r'[^"]*(?:""[^"]*)*"(?!")')


def stays_open(line: str, sep: str, inside: bool) -> bool:
    """Is a quoted field open at the end of the line?"""
    at = 0
    if not inside:
        if line.startswith('"'):
            at = 1
        else:
            at = line.find(sep + '"') + len(sep) + 1
            if at == len(sep):
                return False
    while True:
        closed = _TO_CLOSE.match(line, at)
        if not closed:
            return True
        # Whatever follows the closing quote belongs to the field; the next quoted one follows a separator.
        at = line.find(sep + '"', closed.end()) + len(sep) + 1
        if at == len(sep):
            return False


def split_fields(record: str, sep: str) -> list[str]:
    """The fields of a record, without the quotes around them."""
    if '"' not in record:
        return record.split(sep)
    out, at = [], 0
    while True:
        if record.startswith('"', at):
            closed = _TO_CLOSE.match(record, at + 1)
            end = closed.end() if closed else len(record)
            value = record[at + 1 : end - 1 if closed else end].replace('""', '"')
            until = record.find(sep, end)
            value += record[end : until if until >= 0 else len(record)]
        else:
            until = record.find(sep, at)
            value = record[at : until if until >= 0 else len(record)]
        out.append(value)
        if until < 0:
            return out
        at = until + len(sep)


def _runs(batch) -> Iterator[tuple[int, int]]:
    """Stretches of rows of one block; file and block are the first two columns."""
    import numpy as np
    import pyarrow.compute as pc

    n = batch.num_rows
    if not n:
        return
    file, block = batch.column(0), batch.column(1).to_numpy()
    new = (block[1:] != block[:-1]) | pc.not_equal(file.slice(1), file.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    edges = [0, *(np.flatnonzero(new) + 1).tolist(), n]
    yield from zip(edges[:-1], edges[1:])


def _examined(lines, sep: str):
    """(texts, (place, open if outside, open if inside) of lines with a quote, blank lines ahead of each place and in all)."""
    import numpy as np
    import pyarrow.compute as pc

    texts = lines.to_pylist()
    places = np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False)).tolist()
    quoted = [(i, stays_open(texts[i], sep, False), stays_open(texts[i], sep, True)) for i in places]
    blank = np.array([not t.strip() for t in texts])
    return texts, quoted, np.concatenate([[0], np.cumsum(blank)])


_BLOCKS = "file string, block long, lines long, after_out boolean, after_in boolean, records_out long, records_in long"


def _scan_blocks(sep: str):
    """Arrow function: lines (file, block, line) of whole blocks, in order, to one row of _BLOCKS each."""

    def run(batches):
        import pyarrow as pa

        def row():
            return pa.RecordBatch.from_pylist([dict(zip((c.split()[0] for c in _BLOCKS.split(", ")), (*key, lines, *inside, *records)))])

        key, lines, inside, records = None, 0, [], []
        for batch in batches:
            for a, b in _runs(batch):
                here = (batch.column(0)[a].as_py(), batch.column(1)[a].as_py())
                if here != key:
                    if key:
                        yield row()
                    key, lines, inside, records = here, 0, [False, True], [0, 0]
                _, quoted, blank = _examined(batch.column(2).slice(a, b - a), sep)
                for world in (0, 1):
                    done = 0
                    for place, outside, within in quoted:
                        if not inside[world]:
                            records[world] += int(place - done - blank[place] + blank[done]) + 1
                        inside[world], done = (within if inside[world] else outside), place + 1
                    if not inside[world]:
                        records[world] += int(b - a - done - blank[-1] + blank[done])
                lines += b - a
        if key:
            yield row()

    return run


def _cut_blocks(sep: str, pieces: bool):
    """Arrow function: lines (file, block, line, inside, records_ahead, lines_ahead) to records, or to `pieces` of them.

    A piece is what a block holds of a record that begins in an earlier one or does not end in this one.
    """

    def run(batches):
        import pyarrow as pa

        key, inside, number, line_no = None, False, 0, 0
        held, held_from = [], None  # lines of the open record; its first line if that is in this block
        out = ([], [], [], [], [])

        def put(record_no, from_line, lines, piece):
            if piece == pieces:
                for column, value in zip(out, (key[0], key[1], record_no, from_line, "\n".join(lines))):
                    column.append(value)

        def emitted():
            types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["file", "block", "record", "line_no", "text"])
            for column in out:
                column.clear()
            return batch

        def end_of_block():
            if key and inside:
                put(number - 1, held_from, held, True)

        for batch in batches:
            for a, b in _runs(batch):
                here = (batch.column(0)[a].as_py(), batch.column(1)[a].as_py())
                if here != key:
                    end_of_block()
                    key, held, held_from = here, [], None
                    inside, number, line_no = (batch.column(c)[a].as_py() for c in (3, 4, 5))
                texts, quoted, _ = _examined(batch.column(2).slice(a, b - a), sep)
                done = 0
                for place, outside, within in [*quoted, (len(texts), None, None)]:
                    if inside:
                        held.extend(texts[done:place])
                    elif pieces:
                        number += sum(1 for t in texts[done:place] if t.strip())
                    else:
                        for i in range(done, place):
                            if texts[i].strip():
                                put(number, line_no + i, texts[i : i + 1], False)
                                number += 1
                    if outside is None:
                        break
                    if not inside:
                        held, held_from, number = [], line_no + place, number + 1
                    held.append(texts[place])
                    now = within if inside else outside
                    if not now:
                        put(number - 1, held_from, held, held_from is None)
                        held, held_from = [], None
                    inside, done = now, place + 1
                line_no += b - a
                if out[0]:
                    yield emitted()
        end_of_block()
        if out[0]:
            yield emitted()

    return run


def _first_states(scanned: DataFrame) -> DataFrame:
    """(file, block, inside, records_ahead, lines_ahead) of every block, one row of _BLOCKS each."""
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    # A block ends in one state whatever it begins in (fixed), in the other one (turn), or as it began.
    fixed = F.col("after_out") == F.col("after_in")
    turns = F.coalesce(F.sum(F.when(F.col("after_out") & ~F.col("after_in"), 1).otherwise(0)).over(ahead), F.lit(0))
    blocks = scanned.withColumn("turns", turns)
    last = F.last(F.when(fixed, F.struct("after_out", "turns")), True).over(ahead)
    blocks = blocks.withColumn("last", last)
    odd = (F.col("turns") - F.coalesce(F.col("last.turns"), F.lit(0))) % 2 == 1
    blocks = blocks.withColumn("inside", F.coalesce(F.col("last.after_out"), F.lit(False)) != odd)
    records = F.when(F.col("inside"), F.col("records_in")).otherwise(F.col("records_out"))
    return blocks.select(
        "file",
        "block",
        "inside",
        F.coalesce(F.sum(records).over(ahead), F.lit(0)).alias("records_ahead"),
        F.coalesce(F.sum("lines").over(ahead), F.lit(0)).alias("lines_ahead"),
    )


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def csv_records(lines: DataFrame, sep: str, bound: int) -> DataFrame:
    """(file, record, line_no, text): the records of each file, numbered from 0, with the number of their first line.

    `lines`: raw lines straight from a text scan with '\n' as line end; `bound`: of its file blocks. Blank lines
    outside quotes are no records; a '\r' that ends a record is dropped.
    """
    raw = lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("mid"),
        F.make_valid_utf8("value").alias("line"),
    )
    scanned = _stored(raw.select("file", "block", "line").mapInArrow(_scan_blocks(sep), _BLOCKS), "csv-scan")
    states = _stored(_first_states(scanned), "csv-states")
    if bound <= BROADCAST_BLOCKS:  # the order of the lines stays
        placed = raw.join(F.broadcast(states), ["file", "block"])
    else:
        placed = raw.join(states, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "mid")
    placed = placed.select("file", "block", "line", "inside", "records_ahead", "lines_ahead")
    kind = "file string, block long, record long, line_no long, text string"
    pieces = placed.mapInArrow(_cut_blocks(sep, True), kind).groupBy("file", "record").agg(
        F.min("line_no").alias("line_no"), F.array_sort(F.collect_list(F.struct("block", "text"))).alias("parts")
    )
    joined = F.array_join(F.transform("parts", lambda p: p["text"]), "\n")
    pieces = _stored(pieces.select("file", "record", "line_no", joined.alias("text")), "csv-pieces")
    whole = placed.mapInArrow(_cut_blocks(sep, False), kind).select("file", "record", "line_no", "text")
    records = whole.unionByName(pieces)
    text = F.col("text")
    return records.withColumn("text", F.when(text.endswith("\r"), text.substr(F.lit(1), F.char_length(text) - 1)).otherwise(text))


def fields_of(text: Column, sep: str) -> Column:
    """A record's fields as an array of strings."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_fields(t, sep))

    return split(text)


def left_open(line: Column, sep: str) -> Column:
    """Does a line that begins a record end inside a quoted field?"""

    @F.pandas_udf("boolean")
    def opened(lines: pd.Series) -> pd.Series:
        return lines.map(lambda t: stays_open(t, sep, False))

    return opened(line)
