"""Benchmark decontamination by greedy string tiling.

Seeds are the runs of `seed` consecutive words (lower-cased, without punctuation) of the benchmark
items. The corpus is scanned once; a bitmap of fixed size, whatever the benchmark's, passes the
positions whose hash may be a seed, and only the words around those positions leave the scan. The
exact join of shared seeds follows in Spark. Each pair of a document and an item that share a seed
is tiled: again and again the longest common run of words that are not yet marked, at least `seed`
long, is found by running Karp-Rabin hashes and marked in both. The marked share of the item is its
coverage, whatever order its parts stand in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.functions.columns import free_name
from tablelens.llm.common import LETTERS, kept, lowered, mixed, span_hashes, text_bytes, words_of_rows

#: Bits of the seed filter.
FILTER_BITS = 22
#: Base and modulus of the running hashes.
BASE, PRIME = 1_000_003, (1 << 61) - 1


def _seeds(column, seed: int):
    """Words and seed hashes of all rows: (bytes, word starts, word ends, first word of each row, hash at each word or 0)."""
    data, offsets = text_bytes(column)
    data = lowered(data)
    starts, ends, first = words_of_rows(data, offsets, LETTERS)
    words = span_hashes(data, starts, ends)
    n = len(words) - seed + 1
    hashes = np.zeros(len(words), np.uint64)
    if n > 0:
        run = np.zeros(n, np.uint64)
        for k in range(seed):
            run = mixed(run * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n])
        hashes[:n] = run
    valid = np.zeros(len(words), bool)
    valid[:max(n, 0)] = True
    for k in range(1, seed):  # no seed reaches into the next row
        at = first[1:] - k
        valid[at[(at >= first[:-1])]] = False
    return data, starts, ends, first, hashes, valid


def running_hashes(words: list[int], length: int) -> list[int]:
    """Karp-Rabin hashes of every run of `length` words, each from the one before it."""
    if len(words) < length:
        return []
    lead = pow(BASE, length - 1, PRIME)
    h = 0
    for w in words[:length]:
        h = (h * BASE + w) % PRIME
    out = [h]
    for i in range(length, len(words)):
        h = ((h - words[i - length] * lead) * BASE + words[i]) % PRIME
        out.append(h)
    return out


def tiles(doc: list[str], item: list[str], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (position in doc, position in item, length), longest first, ties leftmost.

    An empty string in `doc` is a gap that no tile spans.
    """
    number: dict[str, int] = {}
    for w in item:
        number.setdefault(w, len(number) + 1)
    a = [number.get(w, 0) for w in doc]  # 0: a word that the item lacks, never part of a tile
    b = [number[w] for w in item]
    free_a, free_b = [x > 0 for x in a], [True] * len(b)
    found = []

    def matches(length: int) -> list[tuple[int, int]]:
        """Equal unmarked runs of this length, by running hashes and then word by word."""
        where: dict[int, list[int]] = {}
        for j, h in enumerate(running_hashes(b, length)):
            if all(free_b[j : j + length]):
                where.setdefault(h, []).append(j)
        return [
            (i, j)
            for i, h in enumerate(running_hashes(a, length))
            if h in where and all(free_a[i : i + length])
            for j in where[h]
            if a[i : i + length] == b[j : j + length]
        ]

    while True:
        starts = matches(least)
        best: list[tuple[int, int, int]] = []
        longest = 0
        for i, j in starts:  # grow every seed to its maximal unmarked run
            n = least
            while i + n < len(a) and j + n < len(b) and free_a[i + n] and free_b[j + n] and a[i + n] == b[j + n]:
                n += 1
            if n > longest:
                best, longest = [], n
            if n == longest:
                best.append((i, j, n))
        if not best:
            return found
        for i, j, n in best:
            if all(free_a[i : i + n]) and all(free_b[j : j + n]):
                free_a[i : i + n] = [False] * n
                free_b[j : j + n] = [False] * n
                found.append((i, j, n))


def coverage(
    docs: DataFrame, benchmark: DataFrame, seed: int = 5, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(doc_id, text_hash, item_id, covered, item_words, tiles): every pair that shares a seed.

    `covered` counts the item's words inside tiles, at most `item_words`; `tiles` are (start in the
    document's matching words, start in the item, length). Items shorter than `seed` words share no
    seed. Null texts count as empty and share none.
    Repeated rows with equal id and text are one pair; no documents or no items give no rows.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))

    def of_items(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            data, starts, ends, first, hashes, valid = _seeds(batch.column("text"), seed)
            raw = data.tobytes()
            words = [[raw[s:e].decode(errors="replace") for s, e in zip(starts[x:y], ends[x:y])] for x, y in zip(first[:-1], first[1:])]
            seeds = [np.unique(hashes[x:y][valid[x:y]]).view(np.int64).tolist() for x, y in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id"), pa.array(words, pa.list_(pa.string())), pa.array(seeds, pa.list_(pa.int64()))], ["item_id", "item", "seeds"]
            )

    table = kept(items.mapInArrow(of_items, "item_id long, item array<string>, seeds array<long>"), "seeds")
    table = table.withColumn("item_key", F.xxhash64("item_id", "item"))
    seeds = table.select("item_key", F.explode("seeds").alias("seed")).distinct()
    # at most 2^FILTER_BITS numbers, however large the benchmark
    low = seeds.select(F.col("seed").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)).alias("low")).distinct()
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[low.toArrow().column(0).to_numpy()] = True
    shared = spark.sparkContext.broadcast(np.packbits(bits))
    chosen = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"),
        F.col(text_col).cast("string").alias("text"),
    )

    def of_docs(batches: Iterator) -> Iterator:
        import pyarrow as pa

        passes = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            data, starts, ends, first, hashes, valid = _seeds(batch.column("text"), seed)
            hit = passes[(hashes & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] & valid
            places = np.flatnonzero(hit)
            rows = np.unique(np.searchsorted(first, places, side="right") - 1)
            covered = np.zeros(len(hit) + seed, bool)
            for k in range(seed):
                covered[places + k] = True
            words, found = [], []
            for row in rows.tolist():
                x, y = int(first[row]), int(first[row + 1])
                at = np.flatnonzero(covered[x:y]) + x
                text: list[str] = []
                last = None
                for p in at.tolist():
                    if last is not None and p != last + 1:
                        text.append("")
                    text.append(data[starts[p] : ends[p]].tobytes().decode(errors="replace"))
                    last = p
                words.append(text)
                found.append(np.unique(hashes[x:y][hit[x:y]]).view(np.int64).tolist())
            rows = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(rows), batch.column("text_hash").take(rows), pa.array(words, pa.list_(pa.string())), pa.array(found, pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "words", "seeds"],
            )

    near = kept(chosen.mapInArrow(of_docs, "doc_id long, text_hash long, words array<string>, seeds array<long>"), "seeded")
    key = F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), "text_hash")
    near = near.withColumn("key", key).dropDuplicates(["key"])
    pairs = near.select("key", F.explode("seeds").alias("seed")).join(seeds, "seed").select("key", "item_key").distinct()
    both = pairs.join(near.drop("seeds"), "key").join(table.select("item_key", "item_id", "item").dropDuplicates(["item_key"]), "item_key")

    def tile(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = [tiles(d, i, seed) for d, i in zip(batch.column("words").to_pylist(), batch.column("item").to_pylist())]
            lengths = [len(i) for i in batch.column("item").to_pylist()]
            kind = pa.list_(pa.struct([("at", pa.int32()), ("item_at", pa.int32()), ("length", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_hash"),
                    batch.column("item_id"),
                    pa.array([sum(t[2] for t in ts) for ts in out], pa.int32()),
                    pa.array(lengths, pa.int32()),
                    pa.array([[{"at": x, "item_at": y, "length": n} for x, y, n in ts] for ts in out], kind),
                ],
                ["doc_id", "text_hash", "item_id", "covered", "item_words", "tiles"],
            )

    return both.select("doc_id", "text_hash", "item_id", "words", "item").mapInArrow(
        tile,
        "doc_id long, text_hash long, item_id long, covered int, item_words int, tiles array<struct<at:int,item_at:int,length:int>>",
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, seed: int = 5, **columns: str) -> DataFrame:
    """The rows of `coverage` whose covered share of the item reaches `threshold`, with that share."""
    share = F.col("covered") / F.col("item_words")
    return coverage(docs, benchmark, seed, **columns).withColumn("coverage", share).where(share >= threshold)


def decontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, seed: int = 5) -> DataFrame:
    """`docs` without the rows that cover an item; every other row stays, null ids and texts included."""
    mark, text_mark = free_name("id", docs.columns), free_name("text_hash", docs.columns)
    bad = contaminated(docs, benchmark, threshold, seed).select(F.col("doc_id").alias(mark), F.col("text_hash").alias(text_mark)).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(mark)) & (F.xxhash64(docs["text"].cast("string")) == F.col(text_mark))
    return docs.join(bad, same, "left_anti")
