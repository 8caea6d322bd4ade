"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as the sum of embeddings of the whole word and of its characters: every run of 4 bytes,
its first 3, 5 and 6 bytes and its last 3. In scripts without spaces every character is a word, and
longer words enter as pieces that overlap, so that every run of 4 bytes is read; both alike in training
and scoring. Features that the training sample lacks add nothing. Two gated
recurrent units read a window of words forwards and backwards, attention pools their states, and a
logistic unit scores the window. Windows overlap by half and cover the whole text; a text scores as
its highest window.

Training. The labelled texts are sampled by the hash of their ids, at most `per_class` toxic ones and
`others` times as many others, with at most `windows_per_text` windows of each, evenly spaced: the
sample, and with it the vocabulary, the driver's memory and the broadcast model, are bounded by
these parameters. A word repeated at once counts once. A first pass takes every window by its text's label; later passes learn from each text's highest window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import LETTERS, lowered, mixed, span_hashes, text_bytes, words_of_rows

LENGTH, STRIDE = 32, 16
DIM, HIDDEN, ATTENTION = 16, 8, 8
PREFIXES, SUFFIX = (3, 5, 6), 3
#: Bytes in a run, and runs that a piece of a word holds at most.
GRAM, PIECE = 4, 16
#: Slots of the feature table; one feature each, the more frequent one stays.
SLOTS = 1 << 19
FEATURES = 2 + len(PREFIXES) + PIECE
#: Windows whose words are looked up at a time, and windows that the network reads at a time.
BLOCK, STEP = 8192, 512
#: Bytes of text that are read at a time, but for a single longer text.
SLICE = 1 << 20


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(words, FEATURES) hashes; 0 where a word is too short for a feature."""
    out = np.zeros((len(starts), FEATURES), np.uint64)
    length = ends - starts
    out[:, 0] = span_hashes(data, starts, ends, 1)
    for k, n in enumerate(PREFIXES, 1):
        long = length >= n
        out[long, k] = span_hashes(data, starts[long], starts[long] + n, 1 + n)
    long = length >= SUFFIX
    out[long, 1 + len(PREFIXES)] = span_hashes(data, ends[long] - SUFFIX, ends[long], 99)
    for k in range(PIECE):
        long = length >= k + GRAM
        if not long.any():
            break
        out[long, FEATURES - PIECE + k] = span_hashes(data, starts[long] + k, starts[long] + k + GRAM, 101)
    return out


def _characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 with its punctuation beyond ASCII blanked, and the begins and ends, in order, of characters that are words of their own."""
    at = np.flatnonzero(data >= 0xC2)  # first bytes
    if not len(at):
        return data, at
    padded = np.r_[data, np.zeros(3, np.uint8)]
    lead, b, c, d = (padded[at + k].astype(np.int32) for k in range(4))
    size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
    code = np.where(lead < 0xE0, (lead & 31) << 6 | b & 63, (lead & 15) << 12 | (b & 63) << 6 | c & 63)
    code = np.where(lead >= 0xF0, (lead & 7) << 18 | (b & 63) << 12 | (c & 63) << 6 | d & 63, code)
    within = lambda *spans: np.logical_or.reduce([(code >= x) & (code <= y) for x, y in spans])
    # Latin-1 signs but for three letters, general punctuation but for joiners, CJK and full-width punctuation
    blank = within((0x80, 0xA9), (0xAB, 0xB4), (0xB6, 0xB9), (0xBB, 0xBF), (0xD7, 0xD7), (0xF7, 0xF7), (0x2000, 0x200B), (0x200E, 0x206F), (0x3000, 0x3004), (0x3008, 0x3020), (0x3030, 0x3030), (0x303D, 0x303F), (0x30FB, 0x30FB), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65))
    # Thai, Lao, Myanmar, Khmer, CJK, half-width kana, rarer Han
    alone = ~blank & within((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0xA4CF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF))
    if blank.any():
        data = data.copy()
        for k in range(3):
            data[at[blank & (size > k)] + k] = 32
    return data, np.unique(np.r_[at[alone], (at + size)[alone]])


def read_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, ends and first words of lower-cased rows; a word repeated at once counts once.

    Pieces of a word overlap by one byte less than a run.
    """
    data, cuts = _characters(data)
    starts, ends, first = words_of_rows(data, offsets, LETTERS)
    if not len(starts):
        return starts, ends, first
    if len(cuts):
        word = np.maximum(np.searchsorted(starts, cuts, side="right") - 1, 0)
        cuts = cuts[(cuts > starts[word]) & (cuts < ends[word])]
        starts, ends = np.sort(np.r_[starts, cuts]), np.sort(np.r_[ends, cuts])
        first = np.searchsorted(starts, offsets)
    pieces = np.maximum(-(-(ends - starts - GRAM + 1) // PIECE), 1)
    if pieces.max() > 1:
        word = np.repeat(np.arange(len(starts)), pieces)
        total = np.r_[0, np.cumsum(pieces)]
        starts = starts[word] + PIECE * (np.arange(len(word)) - total[word])
        ends, first = np.minimum(starts + PIECE + GRAM - 1, ends[word]), total[first]
    h = span_hashes(data, starts, ends, 1)
    new = np.r_[True, h[1:] != h[:-1]]
    new[first[:-1][first[:-1] < len(new)]] = True
    return starts[new], ends[new], np.r_[0, np.cumsum(new)][first]


class Vocabulary:
    """Row numbers of known features; 0 for all others."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.argsort(-counts, kind="stable")
        slot = self._slot(hashes[order])
        _, first = np.unique(slot, return_index=True)
        chosen = hashes[order][np.sort(first)]
        self.hash = np.zeros(SLOTS, np.uint64)
        self.row = np.zeros(SLOTS, np.int32)
        self.hash[self._slot(chosen)] = chosen
        self.row[self._slot(chosen)] = np.arange(1, len(chosen) + 1)
        self.size = len(chosen) + 1

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (mixed(h) & np.uint64(SLOTS - 1)).astype(np.int64)

    def rows(self, h: np.ndarray) -> np.ndarray:
        slot = self._slot(h)
        return np.where((self.hash[slot] == h) & (h != 0), self.row[slot], 0)


def windows_of(counts: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts (in words of their text), lengths, and texts; every text has at least one window."""
    extra = np.maximum(counts - LENGTH, 0)
    per = 1 + -(-extra // stride)
    text = np.repeat(np.arange(len(counts)), per)
    place = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    start = np.minimum(place * stride, extra[text])
    return start, np.minimum(counts[text] - start, LENGTH), text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


class Network:
    """Parameters, forward pass and gradients for windows of LENGTH embedded words."""

    def __init__(self, vocabulary: int, seed: int = 7):
        g = np.random.default_rng(seed)
        r = lambda *s: (g.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.embedding = np.zeros((vocabulary, DIM), np.float32)
        self.p = {}
        for side in ("f", "b"):
            self.p |= {f"W{side}": r(DIM, 3 * HIDDEN), f"U{side}": r(HIDDEN, 3 * HIDDEN), f"c{side}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {
            "A": r(2 * HIDDEN, ATTENTION), "a": np.zeros(ATTENTION, np.float32), "v": r(ATTENTION),
            "w": r(2 * HIDDEN), "bias": np.zeros(1, np.float32),
        }

    def _read(self, x: np.ndarray, mask: np.ndarray, side: str, keep: bool):
        p, n, h2 = self.p, len(x), 2 * HIDDEN
        u, gates = p[f"U{side}"], x @ p[f"W{side}"] + p[f"c{side}"]
        h = np.zeros((n, HIDDEN), np.float32)
        states = np.zeros((n, x.shape[1], HIDDEN), np.float32)
        steps, trace = range(x.shape[1]) if side == "f" else range(x.shape[1] - 1, -1, -1), []
        for t in steps:
            zr = _sigmoid(gates[:, t, :h2] + h @ u[:, :h2])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(gates[:, t, h2:] + (r * h) @ u[:, h2:])
            m = mask[:, t, None]
            new = h + m * z * (c - h)
            if keep:
                trace.append((t, h, z, r, c, m))
            states[:, t] = h = new
        return states, trace

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows; x (n, LENGTH, DIM), mask (n, LENGTH) as floats."""
        p = self.p
        f, tf = self._read(x, mask, "f", keep)
        b, tb = self._read(x, mask, "b", keep)
        s = np.concatenate([f, b], axis=2)
        q = np.tanh(s @ p["A"] + p["a"])
        e = q @ p["v"]
        e = np.exp(e - e.max(axis=1, keepdims=True)) * mask
        weight = e / np.maximum(e.sum(axis=1, keepdims=True), 1e-20)
        pooled = (weight[:, :, None] * s).sum(axis=1)
        return pooled @ p["w"] + p["bias"][0], (x, mask, tf, tb, s, q, weight, pooled)

    def logits(self, x: np.ndarray, place: np.ndarray, lengths: np.ndarray, room: dict[int, list[np.ndarray]]) -> np.ndarray:
        """`forward` without gradients: x has a row for each word, place (LENGTH, n) says which word stands where.

        Arrays are units by windows, so that every operation runs along the windows; `room` keeps them for the next call.
        """
        p, n, h2, h3 = self.p, place.shape[1], 2 * HIDDEN, 3 * HIDDEN
        if n not in room:
            room.clear()
            room[n] = [np.empty(shape, np.float32) for shape in ((LENGTH, n, DIM), (LENGTH, 2 * h3, n), (LENGTH, h2, n), (h2, n), (HIDDEN, n))]
        words, gates, states, a, b = room[n]
        np.take(x, place, axis=0, out=words, mode="clip")
        # Halved, for a sigmoid is half a hyperbolic tangent of the half.
        half = np.r_[np.full(h2, 0.5), np.ones(HIDDEN)].astype(np.float32)[:, None]
        inward = np.concatenate([p["Wf"].T * half, p["Wb"].T * half])
        constant = np.concatenate([p["cf"][:, None] * half, p["cb"][:, None] * half])
        within = np.arange(LENGTH)[:, None] < lengths
        mask = None if lengths.min() == LENGTH else within.astype(np.float32)
        for t in range(LENGTH):
            np.matmul(inward, words[t].T, out=gates[t])
            gates[t] += constant
        for k, side in enumerate("fb"):
            uz, uc = 0.5 * p[f"U{side}"][:, :h2].T, p[f"U{side}"][:, h2:].T
            h = np.zeros((HIDDEN, n), np.float32)
            for t in range(LENGTH) if side == "f" else range(LENGTH - 1, -1, -1):
                zr, new = gates[t, k * h3 : k * h3 + h2], gates[t, k * h3 + h2 : k * h3 + h3]
                zr += np.matmul(uz, h, out=a)
                np.tanh(zr, out=zr)
                zr *= 0.5
                zr += 0.5
                z, r = zr[:HIDDEN], zr[HIDDEN:]
                r *= h
                new += np.matmul(uc, r, out=b)
                np.tanh(new, out=new)
                new -= h
                new *= z
                if mask is not None:
                    new *= mask[t]
                h = np.add(h, new, out=states[t, k * HIDDEN : (k + 1) * HIDDEN])
        e, value = np.empty((LENGTH, n), np.float32), np.empty((LENGTH, n), np.float32)
        for t in range(LENGTH):
            np.matmul(p["A"].T, states[t], out=b)
            b += p["a"][:, None]
            e[t], value[t] = p["v"] @ np.tanh(b, out=b), p["w"] @ states[t]
        e = np.exp(e - e.max(axis=0)) * within
        return (e * value).sum(axis=0) / np.maximum(e.sum(axis=0), 1e-20) + p["bias"][0]

    def gradients(self, d: np.ndarray, cache) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters and of x, given those of the logits."""
        p, (x, mask, tf, tb, s, q, weight, pooled) = self.p, cache
        g = {"w": pooled.T @ d, "bias": d.sum(keepdims=True)}
        d_pooled = d[:, None] * p["w"]
        d_weight = (s * d_pooled[:, None, :]).sum(axis=2)
        d_s = weight[:, :, None] * d_pooled[:, None, :]
        d_e = weight * (d_weight - (weight * d_weight).sum(axis=1, keepdims=True))
        d_q = d_e[:, :, None] * p["v"] * (1 - q * q)
        g["v"] = np.einsum("nt,nta->a", d_e, q)
        g["A"], g["a"] = np.einsum("nth,nta->ha", s, d_q), d_q.sum(axis=(0, 1))
        d_s += d_q @ p["A"].T
        d_x = np.zeros_like(x)
        h2 = 2 * HIDDEN
        for side, trace, part in (("f", tf, d_s[:, :, :HIDDEN]), ("b", tb, d_s[:, :, HIDDEN:])):
            u, w = p[f"U{side}"], p[f"W{side}"]
            gu, gw, gc = np.zeros_like(u), np.zeros_like(w), np.zeros(3 * HIDDEN, np.float32)
            d_h = np.zeros((len(x), HIDDEN), np.float32)
            for t, h, z, r, c, m in reversed(trace):
                d_h = d_h + part[:, t]
                d_c = d_h * m * z * (1 - c * c)
                d_z = d_h * m * (c - h) * z * (1 - z)
                d_rh = d_c @ u[:, h2:].T
                d_r = d_rh * h * r * (1 - r)
                d_zr = np.concatenate([d_z, d_r], axis=1)
                d_gate = np.concatenate([d_zr, d_c], axis=1)
                gu[:, :h2] += h.T @ d_zr
                gu[:, h2:] += (r * h).T @ d_c
                gw += x[:, t].T @ d_gate
                gc += d_gate.sum(axis=0)
                d_x[:, t] += d_gate @ w.T
                d_h = d_h * (1 - m * z) + d_rh * r + d_zr @ u[:, :h2].T
            g |= {f"U{side}": gu, f"W{side}": gw, f"c{side}": gc}
        return g, d_x

    def embedded(self, rows: np.ndarray) -> np.ndarray:
        """Sum of the embeddings of each word's features; row 0 is zero."""
        out = self.embedding[rows[..., 0]]
        for k in range(1, rows.shape[-1]):
            out = out + self.embedding[rows[..., k]]
        return out


class Model:
    """A trained network with its vocabulary; `share` alone where training had only one class."""

    def __init__(self, vocabulary: Vocabulary | None, network: Network | None, share: float):
        self.vocabulary, self.network, self.share = vocabulary, network, share

    def scores(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, stride: int = STRIDE) -> np.ndarray:
        """One score from 0 to 1 for each text: that of its highest window."""
        counts = np.diff(first)
        if self.network is None:
            return np.full(len(counts), self.share)
        start, length, text = windows_of(counts, stride)
        start = start + first[:-1][text]
        logits = np.empty(len(start), np.float32)
        steps, room = np.arange(LENGTH)[:, None], {}
        for at in range(0, len(start), BLOCK):
            s, n = start[at : at + BLOCK], length[at : at + BLOCK]
            low, high = int(s.min()), int((s + n).max())
            # each distinct word once
            _, some, word = np.unique(span_hashes(data, starts[low:high], ends[low:high], 1), return_index=True, return_inverse=True)
            x = self.network.embedded(self.vocabulary.rows(word_features(data, starts[low:high][some], ends[low:high][some])))
            x, word = np.concatenate([x, np.zeros((1, DIM), np.float32)]), np.append(word, len(x))
            for k in range(0, len(s), STEP):
                sk, nk = s[k : k + STEP], n[k : k + STEP]
                place = word[np.where(steps < nk, sk - low + steps, len(word) - 1)]
                logits[at + k : at + k + STEP] = self.network.logits(x, place, nk, room)
        highest = np.full(len(counts), -np.inf, np.float32)
        np.maximum.at(highest, text, logits)
        return 1.0 / (1.0 + np.exp(-highest.astype(np.float64)))


def fit(features: np.ndarray, windows: list[np.ndarray], labels: np.ndarray, passes: int = 10, least: int = 3, seed: int = 7) -> Model:
    """A model from distinct words' feature hashes, the last row zeros, and texts as (windows, LENGTH) rows of it, the last one where a window ends early."""
    labels = np.asarray(labels, np.float32)
    if not len(labels) or labels.min() == labels.max():
        return Model(None, None, float(labels.mean()) if len(labels) else 0.0)
    hashes, code = np.unique(features, return_inverse=True)
    code, counts = code.reshape(features.shape).astype(np.int32), np.zeros(len(hashes), np.int64)
    for w in windows:
        counts[np.unique(code[np.unique(w)])] += 1
    few = min(least, 1 + len(labels) // 400)
    use = (counts >= few) & (hashes != 0)
    vocabulary = Vocabulary(hashes[use], counts[use])
    known, words = vocabulary.rows(features), np.concatenate(windows)
    mask = (words != len(features) - 1).astype(np.float32)
    text = np.repeat(np.arange(len(windows)), [len(w) for w in windows])
    net, g = Network(vocabulary.size, seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    squares = np.full((vocabulary.size, 1), 1e-6, np.float32)  # damps words seen once or twice
    share = labels.mean()
    balance = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    step = 0

    def learn(chosen: np.ndarray) -> None:
        nonlocal step
        for at in range(0, len(chosen), 128):
            some = chosen[at : at + 128]
            rows = known[words[some]]
            x = net.embedded(rows)
            logit, cache = net.forward(x, mask[some], keep=True)
            y, weight = labels[text[some]], balance[text[some]]
            grads, d_x = net.gradients(((_sigmoid(logit) - y) * weight / len(some)).astype(np.float32), cache)
            step += 1
            for k, grad in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.99 * second[k] + 0.01 * grad * grad
                net.p[k] = (net.p[k] - 0.01 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            where = rows.reshape(-1, FEATURES)
            flat = d_x.reshape(-1, DIM)
            order = np.argsort(where.ravel(), kind="stable")
            row = where.ravel()[order]
            cuts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            total = np.add.reduceat(flat[order // FEATURES], cuts, axis=0)
            row = row[cuts]
            total, row = total[row > 0], row[row > 0]
            squares[row] += (total * total).mean(axis=1, keepdims=True)
            net.embedding[row] -= 0.1 * total / np.sqrt(squares[row])

    # every window by its text's label, texts of few windows first in weight
    learn(g.permutation(len(text))[: 40 * len(labels)])
    for _ in range(passes):
        x = net.embedded(known)
        logits = np.concatenate([net.forward(x[words[at : at + 4096]], mask[at : at + 4096])[0] for at in range(0, len(text), 4096)])
        order = np.lexsort((logits, text))
        last = np.flatnonzero(np.r_[text[order][1:] != text[order][:-1], True])
        learn(g.permutation(order[last]))
    return Model(vocabulary, net, float(share))


def text_slices(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, lower-cased bytes, offsets) of slices of the rows of an Arrow column."""
    data, offsets = text_bytes(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1)
        yield at, to, lowered(data[offsets[at] : offsets[to]]), offsets[at : to + 1] - offsets[at]
        at = to


def sample(docs: DataFrame, labels: DataFrame, per_class: int, others: int, windows_per_text: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, toxic, words): at most `per_class` toxic texts and `others` times as many others, each cut to its windows' words.

    `labels` has (doc_id, toxic). Texts are chosen by the hash of their id; of longer texts windows
    lie evenly spaced.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = lambda y, n: known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = pick(1, per_class).union(pick(0, per_class * others))  # at most per_class * (1 + others) rows
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # Of several texts of an id the one of the smallest hash.
    joined = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(
        F.first("toxic").alias("toxic"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")
    )

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at, to, data, offsets in text_slices(batch.column("text")):
                starts, ends, first = read_words(data, offsets)
                out = []
                for x, y in zip(first[:-1], first[1:]):
                    begin, length, _ = windows_of(np.array([y - x]), LENGTH)
                    take = np.unique(np.linspace(0, len(begin) - 1, min(len(begin), windows_per_text)).astype(int))
                    words = []
                    for w in take:
                        for k in range(int(begin[w] + x), int(begin[w] + x + length[w])):
                            words.append(data[starts[k] : ends[k]].tobytes())
                    out.append(b" ".join(words))
                rows = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("toxic"), pa.array(out, pa.binary())], ["doc_id", "toxic", "words"])

    return joined.select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(run, "doc_id long, toxic int, words binary")


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1500, others: int = 2, windows_per_text: int = 32, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model learnt from a bounded sample; `labels` has (doc_id, toxic), rows with nulls are left out.

    An id with several labels counts as toxic if one of them is; of several texts of an id one is taken, the
    same one whatever the partitions.
    """
    rows = sorted(sample(docs, labels, per_class, others, windows_per_text, id_col, text_col).collect())
    texts = [bytes(r.words) for r in rows]
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts, ends, first = words_of_rows(data, np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64))
    _, some, word = np.unique(span_hashes(data, starts, ends, 1), return_index=True, return_inverse=True)
    features = np.concatenate([word_features(data, starts[some], ends[some]), np.zeros((1, FEATURES), np.uint64)])
    word = np.r_[word, len(some)].astype(np.int32)
    steps, windows = np.arange(LENGTH), []
    for x, y in zip(first[:-1], first[1:]):
        begin, length, _ = windows_of(np.array([y - x]), LENGTH)
        windows.append(word[np.where(steps < length[:, None], x + begin[:, None] + steps, len(word) - 1)])
    return fit(features, windows, np.array([r.toxic for r in rows]))


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): one row per row, the highest score of the whole text's overlapping windows.

    A null text counts as empty and scores as an empty window. Null and repeated ids keep their
    rows; equal texts score equally; an empty table gives no rows. Texts are read SLICE bytes at a
    time; a single longer text has to fit in memory some forty times.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at, to, data, offsets in text_slices(batch.column("text")):
                score = shared.value.scores(data, *read_words(data, offsets))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, to - at), pa.array(score, pa.float64())], ["doc_id", "score"])

    return chosen.mapInArrow(run, "doc_id long, score double")


def without_toxic(docs: DataFrame, model: Model, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that score below `threshold`, with all their columns; null and empty texts are scored as one empty window."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at, to, data, offsets in text_slices(batch.column(place)):
                yield batch.slice(at, to - at).filter(pa.array(shared.value.scores(data, *read_words(data, offsets)) < threshold))

    return docs.mapInArrow(run, docs.schema)
