"""Cost-balanced packing of tokenised documents into fixed sequences.

Attention over a piece of n tokens costs about ``linear * n + quadratic * n * n``. Documents are
taken block by block where they lie, without a shuffle. Within a block the documents go in
descending length to the cheapest sequence that still has room for all of their tokens; whole
sequences' worth of a longer document stands by itself. What fits nowhere whole is cut into the
widest gaps, so every sequence of a block is full. Tokens beyond a block's last full sequence
move on to the next block; those left at the end of a partition form sequences whose lengths are
powers of two, which need no padding.
"""

from __future__ import annotations

import heapq
import os
from array import array
from collections.abc import Iterator
from itertools import chain, islice, pairwise

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct chunks whose ids a task remembers.
REMEMBERED = 1 << 20
#: How many of them, those seen first, a worker keeps for its next task.
KEPT = 1 << 18
#: Chunks that are encoded in one call.
JOINED = 1_000
#: Characters of the texts that are tokenised at a time, but for a single longer text.
CHARACTERS = 1 << 20
#: Sequences of one partition are numbered from its number times this.
PER_PARTITION = 1 << 40

_TOKENIZERS: dict = {}


class ChunkTokenizer:
    """Ids of texts, byte for byte those of the tokenizer file, with remembered chunks.

    The byte-level split never joins what stands on both sides of a space between two characters
    that are not white space, and nothing before such a space changes what follows it. So a text
    falls into chunks there, and a chunk's ids can be looked up. A chunk beside other white space
    is never remembered; its text goes to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; its threads would only wait for each other
        from tokenizers import Tokenizer

        self.path = path
        self.whole = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.spaced = np.zeros(self.whole.get_vocab_size(), bool)  # ids of tokens that begin with a space
        self.spaced[[i for token, i in self.whole.get_vocab().items() if token.startswith("\u0120")]] = True

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        return [array("I", e.ids).tobytes() for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, chunks: list[str]) -> None:
        """Remember the ids of chunks. They are encoded as one text, in which each begins at a token with a space."""
        ids = np.asarray(self.whole.encode_batch_fast([" " + " ".join(chunks)], add_special_tokens=False)[0].ids, np.uint32)
        starts = np.flatnonzero(self.spaced[ids])
        if len(starts) == len(chunks) and not starts[0]:
            raw, cuts = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
            self.known.update(zip(chunks, [raw[a:b] for a, b in pairwise(cuts)]))
        else:
            self.known.update(zip(chunks, self.encode([" " + c for c in chunks])))

    def forget(self) -> None:
        """Keep the chunks seen first, most frequent ones among them."""
        self.known = dict(islice(self.known.items(), KEPT))

    def ids(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known = {}
        chunks = [t.split(" ") for t in texts]
        firsts = self.encode([parts.pop(0) for parts in chunks])
        new = [c for c in set(chain.from_iterable(chunks)).difference(self.known) if c and c.strip() == c]
        for at in range(0, len(new), JOINED):
            self.learn(new[at : at + JOINED])
        out = []
        for text, parts, first in zip(texts, chunks, firsts):
            before = text[: text.find(" ")][-1:] if parts else ""
            try:
                out.append(self.encode([text])[0] if before.isspace() else first + b"".join(map(self.known.__getitem__, parts)))
            except KeyError:
                out.append(self.encode([text])[0])
        return out


def _tokenizer(path: str) -> ChunkTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ChunkTokenizer(path)
    return _TOKENIZERS[path]


def assign(lengths: list[int], size: int, linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]]]:
    """Pieces (document, start, length, sequence, offset) that fill whole sequences, and what is left.

    What is left is (document, start, length), less than one sequence in total.
    """
    cost = lambda n: linear * n + quadratic * n * n
    pieces, tails, used = [], [], 0
    for d, n in enumerate(lengths):
        for start in range(0, n - size + 1, size):
            pieces.append((d, start, size, used, 0))
            used += 1
        if n % size:
            tails.append((n % size, d, n - n % size))
    tails.sort(key=lambda t: (-t[0], t[1]))
    count = sum(t[0] for t in tails) // size
    if not count:
        return pieces, [(d, start, n) for n, d, start in tails]
    room = [size] * count
    open_by_cost = [(0.0, k) for k in range(count)]
    uncut, widest = [], size
    for n, d, start in tails:
        passed, at = [], None
        while n <= widest and open_by_cost:  # the cheapest sequence with room; those passed over go back
            c, k = heapq.heappop(open_by_cost)
            if room[k] >= n:
                at = k
                break
            passed.append((c, k))
        for x in passed:
            heapq.heappush(open_by_cost, x)
        if at is None:
            widest = min(widest, max(room))
            uncut.append((n, d, start))
            continue
        pieces.append((d, start, n, used + at, size - room[at]))
        room[at] -= n
        if room[at]:
            heapq.heappush(open_by_cost, (c + cost(n), at))
    gaps = [(-r, k) for k, r in enumerate(room) if r]
    heapq.heapify(gaps)
    rest = []
    for n, d, start in uncut:
        while n and gaps:
            r, k = heapq.heappop(gaps)
            take = min(n, -r)
            pieces.append((d, start, take, used + k, size + r))
            start, n = start + take, n - take
            if -r > take:
                heapq.heappush(gaps, (r + take, k))
        if n:
            rest.append((d, start, n))
    return pieces, rest  # the tails hold at least as many tokens as the sequences, so no gap is left


def powers(rest: list[tuple[int, int, int]], size: int) -> list[tuple[int, int, int, int, int]]:
    """What is left of a partition, in sequences whose lengths are powers of two."""
    total, pieces, k = sum(n for _, _, n in rest), [], 0
    todo = list(rest)[::-1]
    while total:
        length = min(size, 1 << (total.bit_length() - 1))
        at = 0
        while at < length:
            d, start, n = todo.pop()
            take = min(n, length - at)
            pieces.append((d, start, take, k, at))
            at += take
            if n > take:
                todo.append((d, start + take, n - take))
        total -= length
        k += 1
    return pieces


def pack(
    docs: DataFrame,
    tokenizer: str,
    size: int = 2048,
    end_id: int = 1,
    linear: float = 1.0,
    quadratic: float = 1.0 / 2048,
    block_tokens: int = 1 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset, cost): one row per piece.

    `ids` holds the piece's token ids as little-endian unsigned 32-bit numbers, `cost` the piece's
    estimated attention cost. Every document ends with `end_id`, so an empty or null text is one
    piece of one token. Very long texts become many pieces; repeated rows and null ids are packed
    as rows of their own; no rows give none. `tokenizer` is the path of a byte-level BPE file that
    every executor can open.
    """
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    end = np.array([end_id], np.uint32).tobytes()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        coder = _tokenizer(tokenizer)
        number = TaskContext.get().partitionId() * PER_PARTITION
        held: list[tuple[int | None, bytes, int, int]] = []  # id, ids, tokens of the document, start of `ids` in it
        tokens = 0

        def rows(pieces) -> pa.RecordBatch:
            picked = []
            for d, start, n, k, offset in pieces:
                doc_id, ids, total, base = held[d]
                picked.append((doc_id, base + start, n, ids[4 * start : 4 * (start + n)], total, number + k, offset, linear * n + quadratic * n * n))
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "cost"]
            kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3 + [pa.float64()]
            columns = list(zip(*picked)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

        def flush():
            nonlocal held, tokens, number
            pieces, rest = assign([len(h[1]) // 4 for h in held], size, linear, quadratic)
            out = rows(pieces)
            number += max((p[3] for p in pieces), default=-1) + 1
            held = [(held[d][0], held[d][1][4 * s : 4 * (s + n)], held[d][2], held[d][3] + s) for d, s, n in rest]
            tokens = sum(len(h[1]) // 4 for h in held)
            return out

        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            ends = np.cumsum([len(t or "") for t in texts])
            at = 0
            while at < len(ids):
                before = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, before + CHARACTERS, side="right")))
                group = ids[at:to], coder.ids([t or "" for t in texts[at:to]])
                at = to
                for doc_id, coded in zip(*group):
                    coded += end
                    held.append((doc_id, coded, len(coded) // 4, 0))
                    tokens += len(coded) // 4
                    if tokens >= block_tokens:
                        yield flush()
        yield flush()
        yield rows(powers([(d, 0, len(h[1]) // 4) for d, h in enumerate(held)], size))
        coder.forget()  # the worker goes on with other tasks, perhaps of another kind

    return chosen.mapInArrow(
        run,
        "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, cost double",
    )
