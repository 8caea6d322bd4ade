"""Repeated passages by a compacted de Bruijn graph over words.

Edges of the graph are the windows of `window` consecutive words, nodes the words that neighbouring
windows share. Only windows that stand in two documents matter, so they are narrowed down first:
a window's minimiser is the smallest hash among its runs of `seed` words, equal windows have equal
minimisers, and neighbouring windows mostly share theirs. One row per run of windows with the same
minimiser is joined with the minimisers that occur in two documents. For the surviving windows
alone the text is read again and 96-bit edges are formed. Per edge a grouped aggregation gives the
first document that has it, how often it occurs, and sums over the documents and places of its
occurrences. Joined back to the occurrences, two neighbours have no branch between them if each
occurrence of the one continues as the other, that is if their counts and documents agree and their
places lie one apart; such neighbours are merged into paths. A path's head edge leads, by one more
join, to the place of the same path in its first document.

Whole documents whose words equal those of an earlier document are settled before, by a hash of all
their words; their windows never enter the graph.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelens.llm.common import LAST_ID, kept, run_hashes, slices, span_hashes, window_places

def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours."""
    done, out = 1, x
    while done * 2 <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    return np.minimum(out[: len(out) - (width - done)], out[width - done :]) if width > done else out


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, id, key, text): id orders null ids last; rows equal in id and text share a key."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.select("doc_id", F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), F.xxhash64("doc_id", F.col("doc_id").isNull(), "text").alias("key"), "text")


def _whole(rows: DataFrame) -> DataFrame:
    """(doc_id, id, key, n_words, s1, s2, sha): word counts and hashes of whole documents."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            counts, s1, s2, sha = [], [], [], []
            for text in batch.column("text"):
                words = text.as_py().encode().split()
                joined = b" ".join(words)
                digest = hashlib.sha256(joined).digest()
                counts.append(len(words))
                s1.append(int.from_bytes(digest[:8], "little", signed=True))
                s2.append(int.from_bytes(digest[8:16], "little", signed=True))
                sha.append(digest.hex())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("id"), batch.column("key"), pa.array(counts, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(sha)],
                ["doc_id", "id", "key", "n_words", "s1", "s2", "sha"],
            )

    return rows.mapInArrow(run, "doc_id long, id long, key long, n_words long, s1 long, s2 long, sha string")


def _minimisers(rows: DataFrame, window: int, seed: int) -> DataFrame:
    """(h, id, key, start, n): runs of neighbouring windows with the same minimiser."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "key"))
            for at, _, data, starts, ends, first in slices(batch.column("text")):
                place, row = window_places(first, window)
                if not len(place):
                    continue
                least = sliding_least(run_hashes(span_hashes(data, starts, ends), seed), window - seed + 1)[place]
                new = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (row[1:] != row[:-1])])
                n = np.diff(np.r_[new, len(place)])
                row = row[new]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(least[new].view(np.int64)), pa.array(ids[at + row]), pa.array(keys[at + row]),
                        pa.array((place[new] - first[row]).astype(np.int32)), pa.array(n.astype(np.int32)),
                    ],
                    ["h", "id", "key", "start", "n"],
                )

    return rows.select("id", "key", "text").mapInArrow(run, "h long, id long, key long, start int, n int")


def _edges(rows: DataFrame, window: int) -> DataFrame:
    """(e1, e2, id, key, pos): the windows at `spots`."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "key"))
            spots = batch.column("spots")
            for at, to, data, starts, ends, first in slices(batch.column("text")):
                e1 = run_hashes(span_hashes(data, starts, ends, 11), window)
                e2 = run_hashes(span_hashes(data, starts, ends, 23), window)
                few = spots[at:to]
                per = np.array(few.value_lengths().to_numpy(zero_copy_only=False), np.int64)
                flat = few.flatten()
                begin, n = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "n"))
                row = np.repeat(np.repeat(np.arange(to - at), per), n)
                pos = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
                place = pos + first[:-1][row]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(e1[place].view(np.int64)), pa.array((e2[place] >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                        pa.array(ids[at + row]), pa.array(keys[at + row]), pa.array(pos.astype(np.int32)),
                    ],
                    ["e1", "e2", "id", "key", "pos"],
                )

    return rows.select("id", "key", "text", "spots").mapInArrow(run, "e1 long, e2 int, id long, key long, pos int")


def _whole_copies(whole: DataFrame) -> DataFrame:
    """Keys of documents whose words, all together, equal those of a document with a smaller id."""
    least = whole.groupBy("s1", "s2", "n_words").agg(F.min("id").alias("owner"), F.max("id").alias("last")).where("owner < last")
    return whole.join(least, ["s1", "s2", "n_words"]).where("id > owner").select("key", "owner").distinct()


def _paths(rows: DataFrame, copies: DataFrame, window: int, seed: int, sources: bool) -> DataFrame:
    """(key, start, n): occurrences of nonbranching paths of n windows that an earlier document has.

    With `sources` also (e1, id, owner) of the path's head, and the paths' first occurrences too.
    """
    runs = _minimisers(rows, window, seed)
    several = runs.groupBy("h").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("h")
    spots = (
        runs.join(several, "h").groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("spots"))  # at most a document's runs
    ).join(copies.select("key"), "key", "left_anti")
    spots = kept(spots, "spots")
    edges = kept(_edges(rows.join(spots, "key"), window), "edges")
    grouped = edges.groupBy("e1", "e2").agg(
        F.min("id").alias("owner"), F.max("id").alias("last"), F.count("*").alias("seen"),
        F.sum(F.pmod(F.hash("id"), F.lit(65536)).cast("long")).alias("docs"), F.sum(F.col("pos").cast("long")).alias("places"),
    )
    repeated = grouped.where("owner < last").drop("last")
    joined = edges.join(repeated, ["e1", "e2"]).where(F.lit(True) if sources else F.col("owner") < F.col("id"))
    # the same for neighbours exactly if counts and documents agree and all places lie one apart
    path = F.xxhash64("owner", "seen", "docs", F.col("places") - F.col("seen") * F.col("pos")).alias("path")
    marked = joined.select("key", "pos", path, *(["e1", "id", "owner"] if sources else []))
    in_doc = Window.partitionBy("key").orderBy("pos")
    earlier = lambda c: F.lag(c).over(in_doc)
    branch = (earlier("path") != F.col("path")) | ~F.col("pos").isin(earlier("pos"), earlier("pos") + 1)  # a repeated row has the same place
    begins = marked.withColumn("head", F.coalesce(branch, F.lit(True)).cast("int"))
    numbered = begins.withColumn("number", F.sum("head").over(in_doc.rowsBetween(Window.unboundedPreceding, 0)))
    of_head = [F.max(F.when(F.col("head") == 1, F.col("e1"))).alias("e1"), F.min("id").alias("id"), F.min("owner").alias("owner")] if sources else []
    found = numbered.groupBy("key", "number").agg(F.min("pos").alias("start"), (F.max("pos") - F.min("pos") + 1).alias("n"), *of_head)
    return kept(found.drop("number"), "paths")


def repeated_spans(docs: DataFrame, window: int = 13, seed: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, source_id, source_start): spans of words that stand in an earlier document.

    Word numbers count from 0; a span has at least `window` words and stands word for word at
    source_start of the first document that has it. Spans that overlap or touch are separate paths.
    A whole copy of an earlier document is one span. Null ids come after all others and have
    null as doc_id; texts that are null, empty or shorter than a window have no spans; rows equal in
    id and text give their spans once.
    """
    rows = _keyed(docs, id_col, text_col)
    whole = kept(_whole(rows), "whole")
    copies = kept(_whole_copies(whole.where(F.col("n_words") >= window)), "copies")
    paths = _paths(rows, copies, window, seed, sources=True)
    sources = paths.where("id = owner").groupBy("e1", F.col("owner")).agg(F.min("start").alias("source_start")).withColumn("source_id", F.col("owner"))
    spans = paths.where("owner < id").join(sources, ["e1", "owner"]).select("id", "start", (F.col("n") + window - 1).alias("length"), "source_id", "source_start")
    of_copies = whole.join(copies, "key").select("id", F.lit(0).alias("start"), F.col("n_words").alias("length"), F.col("owner").alias("source_id"), F.lit(0).alias("source_start")).distinct()
    real = lambda c: F.when(F.col(c) < LAST_ID, F.col(c)).alias("doc_id" if c == "id" else c)
    return spans.union(of_copies).select(real("id"), "start", "length", "source_id", "source_start")


def _rest(rows: DataFrame) -> DataFrame:
    """(key, n_removed, kept): the words outside the spans, joined by one space."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            removed, kept_words = [], []
            for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist()):
                words = text.as_py().encode().split()
                edge = np.zeros(len(words) + 1, np.int32)
                np.add.at(edge, [s["start"] for s in spans], 1)
                np.add.at(edge, [s["start"] + s["length"] for s in spans], -1)
                free = np.cumsum(edge[:-1]) == 0
                removed.append(len(words) - int(free.sum()))
                kept_words.append(b" ".join([w for w, f in zip(words, free.tolist()) if f]).decode())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(removed, pa.int64()), pa.array(kept_words)], ["key", "n_removed", "kept"])

    return rows.select("key", "text", "spans").mapInArrow(run, "key long, n_removed long, kept string")


def without_repeats(docs: DataFrame, window: int = 13, seed: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): one row per row, its repeated words taken out.

    A word goes when it lies in a window of `window` words that also stands in a document with a
    smaller id. The rest is joined by single spaces and hashed. Texts without a full window lose
    nothing; a null text has no words. Rows equal in id and text are no earlier documents of each
    other and give equal results; a null id comes after all others.
    """
    rows = _keyed(docs, id_col, text_col)
    whole = kept(_whole(rows), "whole")
    copies = kept(_whole_copies(whole.where(F.col("n_words") >= window)), "copies")
    paths = _paths(rows, copies, window, seed, sources=False)
    spans = paths.groupBy("key").agg(F.collect_list(F.struct("start", (F.col("n") + window - 1).cast("int").alias("length"))).alias("spans"))
    rest = _rest(rows.join(kept(spans, "spans"), "key")).select("key", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    rest = kept(rest, "rest").dropDuplicates(["key"])
    none = hashlib.sha256(b"").hexdigest()
    gone = copies.select("key", F.lit(True).alias("gone"))
    return whole.join(rest, "key", "left").join(gone, "key", "left").select(
        "doc_id", "n_words",
        F.when(F.col("gone"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("gone"), F.lit(none)).otherwise(F.coalesce("kept_sha256", F.col("sha"))).alias("kept_sha256"),
    )
