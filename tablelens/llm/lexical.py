"""Ranked lexical search, term at a time with a limited set of accumulators.

Documents are counted once into rows of postings. Each task then works through its documents in shards:
for every query the terms are taken rarest first, a document that a term meets gets an accumulator, and once
the best that the remaining terms can add is below the kth partial score, no accumulator is created any
more; those that exist are brought to their exact scores. The bounds are the largest contributions that occur
in the shard, so nothing that could enter its top k is left out. The tops of the shards are ranked by Spark:
no posting leaves the task that reads it, however frequent its term.

Defined results: null and empty texts hold no term and are never found; queries without a term have no rows; each row of
the queries is a query of its own, each row of the documents a document of its own, repeated ids included;
equal scores go by id, a null id last. Queries are taken in blocks of BLOCK_CHARS, whatever their number.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelens.llm.common import LAST_ID, LETTERS, kept, slices, span_hashes

#: Characters of queries that are held at a time: what the driver collects and every task receives.
BLOCK_CHARS = 8 << 20
#: Documents and postings of a shard.
SHARD_DOCS, SHARD_POSTINGS = 1 << 16, 1 << 22
#: Terms are runs of letters and digits; every character beyond ASCII is a letter.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def query_terms(text: str | None) -> Counter:
    """The terms of a query as bytes, A-Z lower-cased, with their number."""
    return Counter(TERM.findall((text or "").encode("utf-8", "surrogatepass").lower()))


def _blocks(queries: DataFrame, key: str, text: str) -> Iterator[list[tuple]]:
    """(id, terms) of the queries, so many at a time as BLOCK_CHARS allows."""
    block, chars = [], 0
    for row in queries.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).toLocalIterator():
        block.append((row.k, query_terms(row.t)))
        chars += len(row.t or "")
        if chars >= BLOCK_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


class _Vocabulary:
    """Terms known by two 64-bit hashes; the first finds a term, the second confirms it."""

    def __init__(self, terms: list[bytes]):
        data = np.frombuffer(b"".join(terms), np.uint8)
        ends = np.cumsum([len(t) for t in terms])
        starts = ends - [len(t) for t in terms]
        first = span_hashes(data, starts, ends)
        self.order = np.argsort(first)
        self.first = first[self.order]
        self.second = span_hashes(data, starts, ends, 1)[self.order]

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words that are terms, the number of each one's term)."""
        hashes = span_hashes(data, starts, ends)
        at = np.minimum(np.searchsorted(self.first, hashes), len(self.first) - 1)
        words = np.flatnonzero(self.first[at] == hashes)
        at = at[words]
        sure = self.second[at] == span_hashes(data, starts[words], ends[words], 1)
        return words[sure], self.order[at[sure]]


def _postings(docs: DataFrame, key: str, text: str, terms: list[bytes]) -> DataFrame:
    """(doc_id, n, terms, counts): a document's terms with repeats, and which of `terms` occur how often."""
    import pyarrow as pa

    vocabulary = _Vocabulary(terms)

    def run(batches):
        for batch in batches:
            for at, to, data, starts, ends, first in slices(batch.column(1), lower=True, letters=LETTERS):
                words, found = vocabulary.find(data, starts, ends)
                row = np.searchsorted(first, words, side="right") - 1
                pairs, counts = np.unique(row * len(terms) + found, return_counts=True)
                offsets = pa.array(np.searchsorted(pairs, np.arange(to - at + 1) * len(terms)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, to - at),
                        pa.array(np.diff(first).astype(np.int64)),
                        pa.ListArray.from_arrays(offsets, pa.array((pairs % len(terms)).astype(np.int32))),
                        pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int32))),
                    ],
                    ["doc_id", "n", "terms", "counts"],
                )

    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<int>")


class Shard:
    """Postings of some documents by term, with what each adds per unit of weight."""

    def __init__(self, n: np.ndarray, docs: np.ndarray, terms: np.ndarray, counts: np.ndarray, n_terms: int, total: int, length: int):
        order = np.argsort(terms, kind="stable")
        self.docs = docs[order]
        tf, m = counts[order].astype(np.int64), 75 + (25 * n[self.docs] * total) // length
        self.adds = (1_000_000_000 * tf) // (1000 * tf + 12 * m)
        self.begins = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.scores, self.has = np.zeros(len(n), np.int64), np.zeros(len(n), bool)

    def top(self, query: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, exact scores, number of accumulators) of what may be among the k best.

        `query`: (term, weight), rarest first. Every document of the k best of the shard is among the returned ones.
        """
        parts = []
        for term, weight in query:
            a, b = self.begins[term], self.begins[term + 1]
            if a < b and weight > 0:
                parts.append((self.docs[a:b], self.adds[a:b], weight))
        left = np.cumsum([int(adds.max()) * w for _, adds, w in parts][::-1])[::-1] if parts else []
        scores, has, made, survivors, number = self.scores, self.has, [], None, 0
        for i, (docs, adds, weight) in enumerate(parts):
            if survivors is None and number >= k:
                so_far = np.concatenate(made)
                made = [so_far]
                if left[i] < np.partition(scores[so_far], number - k)[number - k]:
                    survivors = np.sort(so_far)
            if survivors is None:
                scores[docs] += weight * adds
                new = docs[~has[docs]]
                has[new] = True
                made.append(new)
                number += len(new)
            else:
                at = np.minimum(np.searchsorted(docs, survivors), len(docs) - 1)
                held = docs[at] == survivors
                scores[survivors[held]] += weight * adds[at[held]]
        found = np.concatenate(made) if made else np.zeros(0, np.int64)
        out = scores[found]
        scores[found], has[found] = 0, False
        return found, out, number


def _shards(batches) -> Iterator[tuple[np.ndarray, ...]]:
    """(ids, n, document of each posting, term, count) of as many rows at a time as a shard may have."""
    held, docs, postings = [], 0, 0

    def joined():
        ids, n, sizes, terms, counts = (np.concatenate(column) for column in zip(*held))
        return ids, n, np.repeat(np.arange(len(n)), sizes), terms, counts

    for batch in batches:
        ids = batch.column(0).fill_null(LAST_ID).to_numpy(zero_copy_only=False)
        sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
        held.append((ids, batch.column(1).to_numpy(), sizes, *(batch.column(c).flatten().to_numpy() for c in (2, 3))))
        docs, postings = docs + len(ids), postings + int(sizes.sum())
        if docs >= SHARD_DOCS or postings >= SHARD_POSTINGS:
            yield joined()
            held, docs, postings = [], 0, 0
    if held:
        yield joined()


def _search(postings: DataFrame, queries: list[list[tuple[int, int]]], n_terms: int, total: int, length: int, k: int) -> DataFrame:
    """(query, doc_id, score): the k best documents of each shard for each query."""
    import pyarrow as pa

    def run(batches):
        for ids, n, docs, terms, counts in _shards(batches):
            shard = Shard(n, docs, terms, counts, n_terms, total, length)
            for number, query in enumerate(queries):
                found, scores, _ = shard.top(query, k)
                best = np.lexsort((ids[found], -scores))[:k] if len(found) <= 4 * k else _best(ids[found], scores, k)
                best = best[scores[best] > 0]
                if len(best):
                    found_ids = ids[found[best]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(best), number)), pa.array(found_ids, mask=found_ids == LAST_ID), pa.array(scores[best])],
                        ["query", "doc_id", "score"],
                    )

    return postings.mapInArrow(run, "query long, doc_id long, score long")


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The k best by score, then by id."""
    some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def ranked(
    docs: DataFrame, queries: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text", query_key: str = "item_id", query_text: str = "text"
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest score above 0 for each query."""
    spark = docs.sparkSession
    id_type = queries.schema[query_key].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {id_type}, rank int, doc_id long, score long")
    for block in _blocks(queries, query_key, query_text):
        terms = sorted(set().union(*[t for _, t in block]))
        if not terms:
            continue
        number = {t: i for i, t in enumerate(terms)}
        postings = kept(_postings(docs, key, text, terms), "postings")
        total, length = postings.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        found = postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect()  # a row per query term at most
        df = {r.t: r["count"] for r in found}
        if not df:
            continue
        weights = [math.floor(1000 * math.log((2 * total + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(terms))]
        asked = []
        for _, counted in block:
            rarest = sorted((number[t] for t in counted if number[t] in df), key=lambda i: (df[i], i))
            asked.append([(i, weights[i] * counted[terms[i]]) for i in rarest])
        best = _search(postings.where("n > 0").select("doc_id", "n", "terms", "counts"), asked, len(terms), total, length, k)
        order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(block)], f"query long, item_id {id_type}")
        out = out.unionByName(best.join(names, "query").select("item_id", "rank", "doc_id", "score"))
    return out
