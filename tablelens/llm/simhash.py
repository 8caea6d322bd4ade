"""SimHash near-duplicates, found by anchor-point covering.

Fingerprint: 64 sums over the XXH64 hashes (seed 42) of all word shingles of a text.

Links. Two fingerprints that differ in at most three bits differ in at most one bit in one of
their two 32-bit halves. The anchors of a half are the codewords of the perfect Hamming code of
31 bits, with the 32nd bit as it is: every half lies within covering radius 1 of exactly one
anchor, its home. A fingerprint is replicated to every anchor within radius + threshold = 2 of
its half, at most 17 of 2^27 anchors, and meets every fingerprint whose home that anchor is.
Comparison is per anchor. An anchor with very many fingerprints is cut into blocks that are
compared pair by pair of blocks, so no task holds more than two blocks. Each block pair gives a
spanning forest of its links, never all pairs, which leaves the linked components unchanged.

Components: alternating large-star and small-star steps on the forest's edges, each a grouped
minimum and a join, until nothing changes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.functions.columns import free_name, quoted
from tablelens.llm.common import LAST_ID, kept

#: Fingerprints of one anchor that a block holds.
BLOCK = 2048


def fingerprint_of(words: list[bytes], shingle: int = 3) -> int:
    """The fingerprint of lower-cased words."""
    import xxhash

    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends - 1).tolist()[shingle - 1 :] or [len(joined)]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], 42) for a, b in zip(starts, stops)], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):  # 4 MB of bits at a time
        block = h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp): the fingerprint of each row's whole text as a signed long; null or no words: 0."""
    text = F.col(text_col).cast("string")
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            fps = []
            for text in batch.column("text"):
                words = text.as_py().encode().lower().split() if text.is_valid else []
                fps.append(fingerprint_of(words, shingle))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "text_hash", "fp"]
            )

    return chosen.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _anchors(half: np.ndarray) -> np.ndarray:
    """(17, n): the anchors within distance 2 of each 32-bit half; row 0 is its home, repeats allowed.

    Bit 0 is the free bit; bits 1 to 31 carry the Hamming code, whose syndrome is the exclusive or
    of the numbers of the set bits.
    """
    syndrome = np.zeros(len(half), np.int64)
    for bit in range(1, 32):
        syndrome ^= np.where((half >> bit) & 1, bit, 0)
    odd, one = syndrome > 0, np.int64(1)
    out = np.empty((17, len(half)), np.int64)
    out[0] = np.where(odd, half ^ (one << syndrome), half)
    top = np.floor(np.log2(np.maximum(syndrome, 1))).astype(np.int64)
    for r in range(1, 16):  # two bits whose numbers make up the syndrome; i lacks its top bit, the other has it
        i = ((r >> top) << (top + 1)) | (r & ((one << top) - 1))
        out[r] = np.where(odd, half ^ (one << i) ^ (one << (i ^ syndrome)), out[0])
    out[16] = out[0] ^ 1
    return out


def replicas(fps: DataFrame) -> DataFrame:
    """(anchor, fp, home) for every anchor that a fingerprint is replicated to."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            whole = batch.column("fp").to_numpy(zero_copy_only=False)
            for at in range(0, len(whole), 50_000):
                fp = whole[at : at + 50_000]
                for side in (0, 1):
                    half = (fp.view(np.uint64) >> np.uint64(32 * side)).astype(np.int64) & 0xFFFFFFFF
                    anchors = _anchors(half)
                    anchors |= side << 32
                    fresh = np.ones(anchors.shape, bool)
                    for r in range(1, 17):
                        fresh[r] = ~(anchors[:r] == anchors[r]).any(axis=0)
                    home = np.zeros(anchors.shape, bool)
                    home[0] = True
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(anchors[fresh]),
                            pa.array(np.broadcast_to(fp, anchors.shape)[fresh]),
                            pa.array(home[fresh]),
                        ],
                        ["anchor", "fp", "home"],
                    )

    return fps.select("fp").mapInArrow(run, "anchor long, fp long, home boolean")


def _forest(a: np.ndarray, b: np.ndarray, near: Callable[[int, bool, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest, as pairs of places in `a` and `b`, of the links between the two sides.

    `near(x, from_a, others)` says which places `others` of the other side x is linked with. Each place
    is compared, once, with what no tree has reached yet, so a dense group takes few comparisons.
    """
    rest_a, rest_b = np.arange(len(a)), np.arange(len(b))
    edges = []
    while len(rest_a) and len(rest_b):
        queue, rest_a = [(int(rest_a[0]), True)], rest_a[1:]
        while queue:
            x, from_a = queue.pop()
            others = rest_b if from_a else rest_a
            if not len(others):
                continue
            hit = near(x, from_a, others)
            found = others[hit].tolist()
            if from_a:
                rest_b = others[~hit]
                edges += [(x, y) for y in found]
            else:
                rest_a = others[~hit]
                edges += [(y, x) for y in found]
            queue += [(y, not from_a) for y in found]
    return edges


def in_groups(batches: Iterator, keys: list[str], columns: list[str], work: Callable) -> Iterator:
    """`work(*columns)` of every run of rows with equal keys, runs that go over several batches included; yields (a, b) pairs."""
    import pyarrow as pa

    def done(table):
        key = np.stack([table.column(k).to_numpy().astype(np.int64) for k in keys], axis=1)
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        bounds, out = [0, *cuts.tolist(), len(key)], set()
        data = [table.column(c).to_numpy() for c in columns]
        for x, y in zip(bounds[:-1], bounds[1:]):
            out.update(work(*(d[x:y] for d in data)))
        a, b = zip(*out) if out else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        now = pa.concat_tables([rest, now]) if rest is not None else now
        same = np.ones(len(now), bool)
        for k in keys:
            column = now.column(k).to_numpy()
            same &= column == column[-1]
        cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield done(now.slice(0, cut))
        rest = now.slice(cut)
    if rest is not None:
        yield done(rest)


def links(fps: DataFrame, bits: int = 3) -> DataFrame:
    """(a, b): edges between distinct fingerprints `fp` whose components are those of all links."""
    if not 0 <= bits <= 3:
        raise ValueError("anchors cover up to 3 differing bits")
    copies = kept(replicas(fps), "anchors")
    sizes = copies.groupBy("anchor").agg(
        F.sum(F.col("home").cast("long")).alias("homes"), F.count("*").alias("all")
    )
    met = sizes.where("homes > 0 and all > 1").select(
        "anchor",
        F.ceil(F.col("homes") / BLOCK).cast("int").alias("rows"),
        F.ceil(F.col("all") / BLOCK).cast("int").alias("cols"),
    )
    lot = lambda n: F.pmod(F.xxhash64("fp"), n).cast("int")
    dealt = copies.join(met, "anchor")
    # a home meets every block of replicas, and a replica every block of homes
    homes = dealt.where("home").select(
        "anchor", lot(F.col("rows")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("j"), "fp", F.lit(True).alias("home")
    )
    others = dealt.select(
        "anchor", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), lot(F.col("cols")).alias("j"), "fp", F.lit(False).alias("home")
    )
    blocks = homes.union(others).repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j")

    def compare(fp: np.ndarray, home: np.ndarray) -> list[tuple[int, int]]:
        a, b = fp[home], fp[~home]
        differing = lambda x, y: np.bitwise_count((x ^ y).view(np.uint64))  # noqa: E731  of a signed number it counts the absolute value's bits
        near = lambda x, from_a, others: differing(b[others] if from_a else a[others], a[x] if from_a else b[x]) <= bits
        return [(int(a[i]), int(b[j])) for i, j in _forest(a, b, near) if a[i] != b[j]]

    def run(batches: Iterator) -> Iterator:
        yield from in_groups(batches, ["anchor", "i", "j"], ["fp", "home"], compare)

    return blocks.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, top, root) for every node: `top` names its component, `root` is the component's smallest rank.

    `edges` (a, b) in any direction; `nodes` (node, rank).
    """
    edges = kept(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges"
    )
    state = None
    while True:
        # large star: every larger neighbour is hung on the smallest neighbour
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # small star: a node and its smaller neighbours are hung on the smallest of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(least, "b")
        small = (
            joined.select(F.col("m").alias("a"), F.col("a").alias("b")).union(least.select(F.col("m").alias("a"), "b"))
        ).where("a <> b").distinct()
        edges = kept(small, "edges")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if now == state:
            break
        state = now
    tree = edges.select(F.col("b").alias("node"), F.col("a").alias("top"))
    ranked = nodes.join(tree, "node", "left").select("node", "rank", F.coalesce("top", "node").alias("top"))
    least = ranked.groupBy("top").agg(F.min("rank").alias("root"))
    return ranked.join(least, "top").select("node", "top", "root")


def near_duplicates(docs: DataFrame, bits: int = 3, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp, top, component_id) for every row; `top` is the same fingerprint for all of a component.

    component_id is the smallest doc_id that can be reached over links of `bits` or fewer
    differing bits; equal fingerprints are linked. Rows without words share fingerprint 0. A null
    doc_id keeps its row and never names a component unless all of its component is null. Repeated
    rows give repeated results; no rows give none.
    """
    rows = kept(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(classes, bits), classes.select(F.col("fp").alias("node"), F.col("least").alias("rank")))
    found = found.select(F.col("node").alias("fp"), "top", F.col("root").alias("component_id"))
    return rows.join(found, "fp").select("doc_id", "text_hash", "fp", "top", "component_id")


def one_of_each(docs: DataFrame, bits: int = 3, shingle: int = 3) -> DataFrame:
    """`docs` (doc_id, text and any other columns) with one row of each component of `near_duplicates`.

    The smallest doc_id stays, of its texts the one of the smallest hash; of rows equal in id and text one
    stays. A null id is chosen only where all of a component are null. Texts without words are one component.
    """
    found = near_duplicates(docs, bits, shingle)
    mark, text_mark = free_name("id", docs.columns), free_name("text_hash", docs.columns)
    first = found.groupBy("top").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(LAST_ID)).alias("i"), F.col("text_hash").alias("h"))).alias("first"))
    chosen = kept(first.select(F.col("first.i").alias(mark), F.col("first.h").alias(text_mark)), "chosen")
    marked = docs.withColumn(mark, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))).withColumn(text_mark, F.xxhash64(F.col("text").cast("string")))
    return marked.join(chosen, [mark, text_mark], "left_semi").dropDuplicates([mark, text_mark]).select([quoted(c) for c in docs.columns])


def hexadecimal(fp: Column) -> Column:
    """16 lowercase hexadecimal digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
