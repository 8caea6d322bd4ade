"""Katz backoff language model of order two, in tables.

p(w | u) = f(u) d(c(uw)) c(uw) / c(u)   if the pair uw is stored, else   a(u) p(w)
p(w)     = d(c(w)) c(w) / N             if the word is known, else       the mass left over

d are Good-Turing discounts for counts up to CUTOFF. Pairs are stored from `least` occurrences on,
all of them unless told otherwise; the mass of rarer ones goes to the backoff. a(u) makes the sum over all known words and the unknown
one exactly 1. f(u) is 1 but where nothing would be left for the backoff, where it leaves
1 / (c(u) + 1). A text begins after the end token of the text before it.

Written as sums, log p(text) = sum over tokens of log(f(u) / c(u)), plus log(d c(uw)) for each stored
pair, plus log(a(u) c(u) / f(u)) + log p(w) for each other one. So a pair has to bring its count only, and no
table of pairs is written: the pairs of the training texts are counted once for the discounts and the
weights of the words before them, and rare ones again in the shuffle that brings them together with the
pairs of the texts to score. Only frequent ones are kept, and a bounded number of words and of pairs is broadcast.

Items travel in blocks, one row for each chunk of text and part of the keys; a part holds PART tokens' pairs at most,
whatever the input. Frequent words, and pairs after frequent words, are dealt so that none fills a part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import starmap

import numpy as np
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tablelens.llm.common import crc_remainder, kept, lowered, mixed, shuffles_removed, span_hashes, text_bytes, words_of_rows

#: The end token's number.
END = np.uint64(0x5BD1E9955BD1E995)
CUTOFF = 5
#: Words, and pairs, that are broadcast at most.
FREQUENT = 1 << 19
#: Tokens that a Python worker handles at a time.
CHUNK = 1 << 20
#: Tokens of the input for each part of the pairs.
PART = 3 << 20
#: Items of a chunk of text that fall into one part, as bytes: `u` has each first word once, `runs` how often; `row` points into `keys`.
#: Words are places in the broadcast table, the others (OTHER) follow as they are in `rare_u` and `rare_w`.
BLOCK = "part int, kind int, size long, u binary, rare_u binary, runs binary, w binary, rare_w binary, n binary, row binary, keys binary, trained binary, ids binary, nulls binary, s binary, b binary"
OTHER = (1 << 32) - 1
#: Kinds of blocks and of the rows that they become.
PAIRS, TEXTS, WORDS = 0, 1, 2


def pair_key(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mixed(u * np.uint64(0x9E3779B97F4A7C15) + mixed(w + np.uint64(0x165667B19E3779F9)))


def tokens_of(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, tokens, row of each token) for slices of about CHUNK bytes * 4; each row ends with END."""
    data, offsets = text_bytes(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + 4 * CHUNK, side="right")) - 1)
        part = lowered(data[offsets[at] : offsets[to]])
        starts, ends, first = words_of_rows(part, offsets[at : to + 1] - offsets[at])
        h = span_hashes(part, starts, ends)
        tokens = np.insert(h, first[1:], END)
        counts = np.diff(first) + 1
        yield at, to, tokens, np.repeat(np.arange(to - at), counts)
        at = to


def before(tokens: np.ndarray) -> np.ndarray:
    """The token before each token; a row's first token follows END."""
    out = np.empty_like(tokens)
    if len(tokens):
        out[0], out[1:] = END, tokens[:-1]
    return out


def discounts(n: list[int]) -> list[float]:
    """Good-Turing ratios r*/r, renormalised after Katz, for r = 1 to CUTOFF; n[r] is the number of items seen r times.

    Where the counts of counts give no ratio between 0 and 1, it is (r - 0.5) / r.
    """
    tail = (CUTOFF + 1) * n[CUTOFF + 1] / n[1] if n[1] else 1.0
    out = [1.0]
    for r in range(1, CUTOFF + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if n[r] and tail < 1 else 0.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


def _discounted(c: Column, d: list[float]) -> Column:
    """d(c) * c."""
    out = c.cast("double")
    for r in range(1, CUTOFF + 1):
        out = F.when(c == r, F.lit(d[r] * r)).otherwise(out)
    return out


def _log_discounted(c: np.ndarray, d: list[float]) -> np.ndarray:
    """log10 of d(c) * c."""
    return np.log10(np.where(c <= CUTOFF, np.array(d)[np.minimum(c, CUTOFF)] * c, c))


def _found(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each of `h` in the ascending `keys`, and whether it is there."""
    if not len(keys):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return at, keys[at] == h


def _block_batch(rows: list[dict]):
    import pyarrow as pa

    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in BLOCK.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds[k]) for n, k in fields], [n for n, _ in fields])


def _blocks(kind: int, part: np.ndarray, v: np.ndarray, places: np.ndarray, w: np.ndarray, n: np.ndarray, u=None, row=None, keys=None, trained=None) -> list[dict]:
    """One row of BLOCK for each part; `u` and `w` point into the words `v`, which have `places` in the broadcast table or are OTHER."""
    order = np.argsort(part, kind="stable") if u is None else np.lexsort((u, part))
    names, first = np.unique(part[order], return_index=True)
    named = lambda x: (places[x].astype(np.uint32).tobytes(), v[x[places[x] == OTHER]].tobytes())
    out = []
    for p, at in zip(names, np.split(order, first[1:])):
        r = {"part": int(p), "kind": kind, "n": n[at].astype(np.uint32).tobytes()}
        r["w"], r["rare_w"] = named(w[at])
        if u is not None:
            own, runs = np.unique(u[at], return_counts=True)
            r["u"], r["rare_u"] = named(own)
            r["runs"] = runs.astype(np.uint32).tobytes()
        if row is not None:
            own, place = np.unique(row[at], return_inverse=True)
            r |= {"row": place.astype(np.uint32).tobytes(), "keys": keys[own].tobytes(), "trained": trained[own].tobytes()}
        out.append(r)
    return out


def _unpacked(block: dict, known: np.ndarray) -> dict[str, np.ndarray]:
    """The items of a block; `known` are the broadcast words, key and trained are those of their text."""

    def words(name: str) -> np.ndarray:
        places = np.frombuffer(block[name], np.uint32)
        out = np.empty(len(places), np.uint64)
        other = places == OTHER
        out[~other] = known[places[~other]]
        out[other] = np.frombuffer(block[f"rare_{name}"], np.uint64)
        return out

    out = {"w": words("w"), "n": np.frombuffer(block["n"], np.uint32).astype(np.int64)}
    if block["u"] is not None:
        out["u"] = np.repeat(words("u"), np.frombuffer(block["runs"], np.uint32))
    if block["row"] is not None:
        row = np.frombuffer(block["row"], np.uint32)
        out |= {"key": np.frombuffer(block["keys"], np.int64)[row], "trained": np.frombuffer(block["trained"], bool)[row]}
    return out


def _together(blocks: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """The items of all blocks, which are emptied."""
    return {name: np.concatenate([b.pop(name) for b in blocks]) for name in list(blocks[0])}


def _chunks(batches: Iterator) -> Iterator[tuple]:
    """(batch, first row, last row, trained, words, word of each token, word before each, row of each) of chunks of text; words ascend."""
    for batch in batches:
        trained = batch.column("trained").to_numpy(zero_copy_only=False).astype(bool)
        for at, to, tokens, row in tokens_of(batch.column("text")):
            v, word = np.unique(tokens, return_inverse=True)
            yield batch, at, to, trained[at:to], v, word, np.insert(word[:-1], 0, np.searchsorted(v, END)), row


def _counted_words(docs: DataFrame) -> tuple[DataFrame, Observation]:
    """Counts (w, c) of the words of trained texts; the observation gets the tokens of all texts."""

    def deal(batches: Iterator) -> Iterator:
        for _, _, _, trained, v, word, _, row in _chunks(batches):
            n = np.bincount(word[trained[row]], minlength=len(v))
            some = np.flatnonzero(n)
            places = np.full(len(v), OTHER)
            rows = _blocks(WORDS, (v[some] % np.uint64(parts)).astype(np.int64), v, places, some, n[some]) or [{"part": 0, "kind": WORDS, "w": b"", "rare_w": b"", "n": b""}]
            rows[0]["size"] = len(word)
            yield _block_batch(rows)

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        if blocks := [_unpacked(b, np.zeros(0, np.uint64)) for batch in batches for b in batch.to_pylist()]:
            items = _together(blocks)
            k, at = np.unique(items["w"], return_inverse=True)
            c = np.bincount(at, weights=items["n"], minlength=len(k)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c)], ["w", "c"])

    size = Observation()
    parts = max(2 * docs.sparkSession.sparkContext.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = docs.select("text", "trained").mapInArrow(deal, BLOCK).observe(size, F.sum("size").alias("tokens"))
    return dealt.repartitionById(parts, "part").mapInArrow(add, "w long, c long"), size


def _counted_pairs(docs: DataFrame, parts: int, n: int, frequent, p_of_count, least: int, listed: bool) -> DataFrame:
    """Sums over the pairs of trained texts, added up part by part, or each stored pair if `listed`.

    Sums are rows (kind, k, c, h1 to h5, p): of a word's stored pairs (k: the word, c: all occurrences, h: pairs that occur
    so often, p: sum of p(w)), frequent pairs (k, c) and the number (c) of pairs that occur k times. A pair with a rare last word
    is dealt by that word, so that its part counts the word by itself; one behind a word that would fill a part by the whole pair.
    """

    def deal(batches: Iterator) -> Iterator:
        known, count = frequent.value

        def blocks(batch, first, last, trained, v, word, prior, row):
            at, hit = _found(known, v)
            hot = hit & (count[at] * 16 * parts >= n) if len(count) else hit
            mine = trained[row]
            pair, times = np.unique(prior[mine] * len(v) + word[mine], return_counts=True)
            u, w = pair // max(len(v), 1), pair % max(len(v), 1)
            by = np.where(hit[w], np.where(hot[u], pair_key(v[u], v[w]), v[u]), v[w])
            return _block_batch(_blocks(PAIRS, (by % np.uint64(parts)).astype(np.int64), v, np.where(hit, at, OTHER), w, times, u))

        yield from starmap(blocks, _chunks(batches))

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known, count = frequent.value
        blocks = [_unpacked(b, known) for batch in batches for b in batch.to_pylist()]
        if not blocks:
            return
        items = _together(blocks)
        k, first, at = np.unique(pair_key(items["u"], items["w"]), return_index=True, return_inverse=True)
        c = np.bincount(at, weights=items["n"], minlength=len(k)).astype(np.int64)
        u, w = items["u"][first], items["w"][first]
        del items, at
        stored = c >= least
        if listed:
            columns = [x[stored].view(np.int64) for x in (k, u, w, c)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["k", "u", "w", "c"])
            return
        words, at = np.unique(w, return_inverse=True)
        place, hit = _found(known, words)
        here = np.bincount(at, weights=c, minlength=len(words)).astype(np.int64)
        p = p_of_count(np.where(hit, count[place], here) if len(count) else here)[at][stored]
        firsts, at = np.unique(u[stored], return_inverse=True)
        of_firsts = [np.bincount(at, weights=x, minlength=len(firsts)) for x in (c[stored], *((c[stored] == r) for r in range(1, CUTOFF + 1)), p)]
        often = stored & (c > CUTOFF)
        sizes = np.bincount(np.minimum(c, CUTOFF + 2), minlength=CUTOFF + 3)[1 : CUTOFF + 2]
        for kind, keys, values in (
            (WORDS, firsts.view(np.int64), of_firsts),
            (PAIRS, k[often].view(np.int64), [c[often]]),
            (TEXTS, np.arange(1, CUTOFF + 2), [sizes]),
        ):
            values = [*values, *[np.zeros(len(keys))] * (CUTOFF + 2 - len(values))]
            whole = [pa.array(x.astype(np.int64)) for x in (np.full(len(keys), kind), keys, *values[:-1])]
            yield pa.RecordBatch.from_arrays([*whole, pa.array(values[-1])], ["kind", "k", "c", *(f"h{r}" for r in range(1, CUTOFF + 1)), "p"])

    dealt = docs.select("text", "trained").mapInArrow(deal, BLOCK).repartitionById(parts, "part")
    if listed:
        return dealt.mapInArrow(add, "k long, u long, w long, c long")
    return dealt.mapInArrow(add, f"kind long, k long, c long, {', '.join(f'h{r} long' for r in range(1, CUTOFF + 1))}, p double")


class Terms:
    """A fitted model: the table of its words, the broadcast words and pairs, the totals and the discounts of pairs."""

    def __init__(self, words: DataFrame, pairs, frequent, pair_counts, n: int, v: int, unknown: float, discounts_of_pairs: list[float], least: int, parts: int):
        self.words, self._pairs, self.frequent, self.pair_counts = words, pairs, frequent, pair_counts
        self.n, self.v, self.unknown, self.d2, self.least, self.parts = n, v, unknown, discounts_of_pairs, least, parts

    @property
    def table(self) -> DataFrame:
        """(k, score, base, known): log p(w) + log a(w) of every word, the gain of every stored pair over its backoff; counts the pairs anew."""
        words = self.words
        pairs = self._pairs().join(words.select("w", "lp"), "w").join(words.select(F.col("w").alias("u"), "x"), "u")
        gain = F.log10(_discounted(F.col("c"), self.d2)) - F.col("x") - F.col("lp")
        return words.select(F.col("w").alias("k"), (F.col("lp") + F.col("x") + F.col("l")).alias("score"), "base", F.lit(1).alias("known")).union(
            pairs.select("k", gain.alias("score"), F.lit(None).cast("double").alias("base"), F.lit(0).alias("known"))
        )


def fit(train: DataFrame, least: int = 1) -> Terms:
    """A model of the texts in `train` (text)."""
    return _fit(train.select("text", F.lit(True).alias("trained")), least)


def _fit(docs: DataFrame, least: int) -> Terms:
    """A model of those texts in `docs` (text, trained) that are trained."""
    spark = docs.sparkSession
    send = spark.sparkContext.broadcast
    seen = Observation()
    counted, size = _counted_words(docs)
    sizes = [F.sum((F.col("c") == r).cast("long")).alias(f"n{r}") for r in range(1, CUTOFF + 2)]
    words = kept(counted.observe(seen, F.sum("c").alias("n"), F.count("*").alias("v"), *sizes), "words")
    got = seen.get
    n, v = got["n"] or 0, got["v"] or 0
    parts = max(2 * spark.sparkContext.defaultParallelism, (size.get["tokens"] or 0) // PART)
    d1 = discounts([0] + [got[f"n{r}"] or 0 for r in range(1, CUTOFF + 2)])
    mass = words.agg(F.sum(_discounted(F.col("c"), d1))).first()[0] / n if n else 1.0
    scale = min(1.0, (n / (n + 1)) / mass) if n else 1.0  # something is left for the unknown word
    unknown = math.log10(1 - mass * scale) if n else 0.0
    counts = send(_frequent(words, "w", ["c"], np.int64))
    p_of_count = lambda c: np.where(c <= CUTOFF, np.array(d1)[np.minimum(c, CUTOFF)] * c, c) * (scale / max(n, 1))
    # pairs
    sums = kept(_counted_pairs(docs, parts, n, counts, p_of_count, least, False), "sums")
    n2 = {r.k: r.n for r in sums.where(F.col("kind") == TEXTS).groupBy("k").agg(F.sum("c").alias("n")).collect()}
    d2 = discounts([0] + [n2.get(r, 0) for r in range(1, CUTOFF + 2)])
    few = [f"h{r}" for r in range(1, CUTOFF + 1)]
    none = F.lit(0).cast("long")
    of_words = words.select("w", "c", none.alias("stored"), *(none.alias(h) for h in few), F.lit(0.0).alias("p"))
    of_words = of_words.union(sums.where(F.col("kind") == WORDS).select("k", none, "c", *few, "p"))
    of_words = of_words.groupBy("w").agg(*(F.sum(x).alias(x) for x in ("c", "stored", *few, "p")))
    lost = sum((F.col(f"h{r}") * (r - r * d2[r]) for r in range(1, CUTOFF + 1)), F.lit(0.0))
    share = (F.col("stored") - lost) / F.col("c")
    most = F.col("c") / (F.col("c") + 1)
    factor = F.when(share > most, most / share).otherwise(F.lit(1.0))
    # l: log f(u) / c(u); x: log a(u) less l
    l_ = F.log10(factor / F.col("c"))
    a = F.log10((1 - factor * share) / F.greatest(1 - F.col("p"), F.lit(1e-300)))
    of_words = kept(of_words.select("w", "c", l_.alias("l"), (a - l_).alias("x")), "contexts")
    of_words = of_words.select(
        "w", "c", F.log10(_discounted(F.col("c"), d1) * F.lit(scale / max(n, 1))).alias("lp"), "l", "x", F.log10((F.col("c") + 1) / F.lit(n + v + 1)).alias("base")
    )
    frequent = send(_frequent(of_words, "w", ["lp", "l", "x", "base"], np.float64))
    pair_counts = send(_frequent(sums.where(F.col("kind") == PAIRS), "k", ["c"], np.int64))
    pairs = lambda: _counted_pairs(docs, parts, n, counts, p_of_count, least, True)
    return Terms(of_words, pairs, frequent, pair_counts, n, v, unknown, d2, least, parts)


def _frequent(table: DataFrame, key: str, columns: list[str], kind) -> tuple[np.ndarray, np.ndarray]:
    """Keys, ascending, and values of at most FREQUENT rows: those that occur (c) at least 2^i times, for the smallest i that allows it."""
    power = F.floor(F.log2(F.col("c").cast("double"))).cast("int")
    # one row per power of two
    sizes = {r.i: r["count"] for r in table.groupBy(power.alias("i")).count().collect()}
    total, at = 0, 64
    while at > 0 and total + sizes.get(at - 1, 0) <= FREQUENT:
        at -= 1
        total += sizes.get(at, 0)
    chosen = table.where(power >= at).select(key, *columns).toArrow()
    keys = chosen.column(key).to_numpy().view(np.uint64)
    order = np.argsort(keys, kind="stable")
    values = [chosen.column(c).to_numpy().astype(kind)[order] for c in columns]
    return keys[order], values[0] if len(values) == 1 else np.stack(values)


#: What the blocks of texts become: sums of a text's frequent terms, sums over its pairs in one part, or a rare word of it.
SCORED = "kind int, doc_id long, key long, w long, n long, m long, b double, s double, x long, y long"


def _scored(kind: int, **columns):
    import pyarrow as pa

    size = len(columns["key"])
    fields = [(f.split()[0], {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[f.split()[1]]) for f in SCORED.split(", ")]
    columns["kind"] = np.full(size, kind, np.int32)
    return pa.RecordBatch.from_arrays([pa.array(columns[f], t) if f in columns else pa.nulls(size, t) for f, t in fields], [f for f, _ in fields])


def evaluate(docs: DataFrame, trained: Column, least: int = 1, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Terms]:
    """(doc_id, n_tokens, n_known, base_score, score): one row per row of `docs`, by the model of those rows that are `trained`; and the model.

    base_score sums log10((c + 1) / (N + V + 1)), score log10 of the model's probability. A null
    text counts as empty: its one token is the end. Null and repeated ids keep their rows; no rows
    give none. Without training texts every probability is 1.
    """
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(trained, F.lit(False)).alias("trained"))
    chosen = chosen.withColumn("key", F.xxhash64("doc_id", F.col("doc_id").isNull(), "text", "trained"))
    model = _fit(chosen, least)
    frequent, pair_counts, d2, unknown, parts = model.frequent, model.pair_counts, model.d2, model.unknown, model.parts

    def deal(batches: Iterator) -> Iterator:
        known, (_, ls, _, bases) = frequent.value
        often, counts = pair_counts.value
        gains = _log_discounted(counts, d2)

        def blocks(batch, at, to, trained, v, word, prior, row):
            size = to - at
            keys = batch.column("key")[at:to].to_numpy(zero_copy_only=False)
            ids = batch.column("doc_id")[at:to]
            place, hit = _found(known, v)
            places = np.where(hit, place, OTHER)
            of_words = [np.where(hit, x[place], 0.0) if len(x) else np.zeros(len(v)) for x in (ls, bases)]
            # a text's words are also the words before its words
            s, b = (np.bincount(row, weights=x[word], minlength=size) for x in of_words)
            m = np.bincount(row[hit[word]], minlength=size)
            pair, of_token = np.unique(prior * len(v) + word, return_inverse=True)
            u, w = pair // len(v), pair % len(v)
            k = pair_key(v[u], v[w])
            place, stored = _found(often, k)
            if len(often):
                s += np.bincount(row, weights=np.where(stored, gains[place], 0.0)[of_token], minlength=size)
            left = ~stored[of_token]
            rare, n = np.unique(row[left] * len(k) + of_token[left], return_counts=True)
            where, rare = rare // len(k), rare % len(k)
            rows = _blocks(PAIRS, (k[rare] % np.uint64(parts)).astype(np.int64), v, places, w[rare], n, u[rare], where, keys, trained)
            left = ~hit[word]
            rare, n = np.unique(row[left] * len(v) + word[left], return_counts=True)
            where, rare = rare // len(v), rare % len(v)
            any_part = int(keys[0] % parts)
            rows += _blocks(WORDS, np.full(len(rare), any_part), v, places, rare, n, None, where, keys, trained)
            texts = {"keys": keys, "ids": ids.fill_null(0).to_numpy(zero_copy_only=False), "nulls": ids.is_null().to_numpy(zero_copy_only=False), "n": np.bincount(row, minlength=size), "w": m, "s": s, "b": b}
            rows.append({"part": any_part, "kind": TEXTS} | {name: x.tobytes() for name, x in texts.items()})
            return _block_batch(rows)

        # a chunk's arrays are gone before the next one is read
        yield from starmap(blocks, _chunks(batches))

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known, (lps, _, xs, _) = frequent.value
        blocks = []
        for block in (b for batch in batches for b in batch.to_pylist()):
            if block["kind"] == TEXTS:
                n, m, ids, keys = (np.frombuffer(block[x], np.int64) for x in ("n", "w", "ids", "keys"))
                s, b = (np.frombuffer(block[x]) for x in ("s", "b"))
                yield _scored(TEXTS, doc_id=pa.array(ids, mask=np.frombuffer(block["nulls"], bool)), key=keys, n=n, m=m, b=b, s=s)
            elif block["kind"] == WORDS:
                items = _unpacked(block, known)
                none = np.zeros(len(items["w"]), np.int64)
                yield _scored(WORDS, key=items["key"], w=items["w"].view(np.int64), n=items["n"], x=none, y=none)
            else:
                blocks.append(_unpacked(block, known))
        if not blocks:
            return
        items = _together(blocks)
        _, at = np.unique(pair_key(items["u"], items["w"]), return_inverse=True)
        c = np.bincount(at, weights=items["n"] * items["trained"]).astype(np.int64)[at]
        stored = c >= least
        s = np.where(stored, items["n"] * _log_discounted(np.maximum(c, 1), d2), 0.0)
        other = np.flatnonzero(~stored)  # these back off
        n, key = items["n"][other], items["key"][other]
        for name, values, to in (("u", xs, "x"), ("w", lps, "y")):
            word = items[name][other]
            place, hit = _found(known, word)
            if len(known):
                s[other] += np.where(hit, n * values[place], 0.0)
            none = np.zeros((~hit).sum(), np.int64)
            yield _scored(WORDS, key=key[~hit], w=word[~hit].view(np.int64), n=none, **({"x": none, "y": none} | {to: n[~hit]}))
        keys, at = np.unique(items["key"], return_inverse=True)
        yield _scored(PAIRS, key=keys, s=np.bincount(at, weights=s))

    scored = kept(chosen.mapInArrow(deal, BLOCK).repartitionById(parts, "part").mapInArrow(score, SCORED), "scored")
    # what rare words add to each text
    found = scored.where(F.col("kind") == WORDS).select("key", "w", "n", "x", "y").join(model.words.withColumnRenamed("x", "lx"), "w", "left")
    lost = math.log10(1 / (model.n + model.v + 1))
    each = lambda n, c, other: F.coalesce(F.col(n) * F.coalesce(c, F.lit(other)), F.lit(0.0))
    found = found.select(
        "key",
        (each("n", "l", 0.0) + each("x", "lx", 0.0) + each("y", "lp", unknown)).alias("s"),
        each("n", "base", lost).alias("b"),
        F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0).alias("m"),
    )
    more = found.union(scored.where(F.col("kind") == PAIRS).select("key", "s", F.lit(0.0), F.lit(0)))
    more = more.groupBy("key").agg(F.sum("s").alias("s2"), F.sum("b").alias("b2"), F.sum("m").alias("m2"))
    whole = scored.where(F.col("kind") == TEXTS).select("doc_id", "key", F.col("n").alias("n_tokens"), "m", "b", "s")
    # rows equal in id and text share a key, and with it their terms
    copies = whole.groupBy("key").agg(F.count("*").alias("copies"))
    out = whole.join(more.join(copies, "key"), "key", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("m") + F.coalesce(F.col("m2") / F.col("copies"), F.lit(0))).cast("long").alias("n_known"),
        (F.col("b") + F.coalesce(F.col("b2") / F.col("copies"), F.lit(0.0))).alias("base_score"),
        (F.col("s") + F.coalesce(F.col("s2") / F.col("copies"), F.lit(0.0))).alias("score"),
    )
    return out, model


def language_model_scores(docs: DataFrame, modulus: int = 7, held: int = 2, least: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`evaluate` of every row by a model of the rows whose crc32(id as text) modulo `modulus` is not `held`.

    Adds held_out and train_tokens.
    """
    rest = lambda column: crc_remainder(F.col(column).cast("long"), modulus)
    with shuffles_removed(docs.sparkSession):
        out, model = evaluate(docs, rest(id_col) != held, least, id_col, text_col)
    return out.select(
        "doc_id", (rest("doc_id") == held).alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score"
    )
