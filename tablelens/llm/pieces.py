"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is cut into symbols; every pair of neighbours whose concatenation is a piece waits in an agenda
ordered by score, the leftmost first among equals. The best pair is merged, its two new neighbours enter
the agenda, and pairs whose symbols have changed meanwhile are passed over. Symbols that are no piece are
written as their UTF-8 bytes, or as the unknown piece where the vocabulary has no bytes.

A merge never reaches over a place that no piece spans, so a text is encoded segment by segment and the
segments that come again are looked up by a 64-bit hash. The cut places follow from the vocabulary alone. The
agendas of many short new segments are worked off side by side, one best pair of each a step, as rows of arrays.
Texts for which the library gives other ids are encoded once more without the table of hashes.

Defined results: a null text counts as empty and gives the end id alone; bytes that are not UTF-8 count as
U+FFFD; rows, repeated ones and those of null id included, are encoded each by itself; extra columns pass
through, and an output column whose name the table already has replaces it. One text at a time has to fit in memory.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.llm.common import span_hashes

SPACE = "▁"
#: Piece types of the model file (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Remembered segments of a Python worker, and the longest that are merged side by side; results depend on neither.
SEGMENTS, SEGMENT_CHARS = 1 << 19, 48
#: Characters of text, or ids, that are worked on at a time, but for a single longer text.
SLICE = 1 << 20


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message; 4-byte values as bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or number()
        yield key >> 3, data[at : at + size]
        at += size


@dataclass
class Vocabulary:
    """What encoding and decoding need of a model file."""

    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    types: list[int] = field(default_factory=list)
    dummy_prefix: bool = True

    def __post_init__(self):
        self.ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t in (NORMAL, UNUSED)}
        self.unknown = self.types.index(UNKNOWN)
        by_byte = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == BYTE}
        self.bytes = [by_byte[b] for b in range(256)] if len(by_byte) == 256 else None
        self.end = self.pieces.index("</s>")
        longer = [p for p in self.ids if len(p) > 1]
        joined = {c for p in longer for c in p}
        # A segment ends before a space that follows another character, and around characters that never merge.
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in longer)
        alone = [c for c in range(128) if chr(c) not in joined and c != ord(" ")]
        self.alone = np.zeros(256, bool)
        self.alone[alone] = True
        within = "".join(re.escape(chr(c)) for c in alone) or "\x00"
        self.segment = re.compile(f"{SPACE}*[^{SPACE}{within}]+|{SPACE}+|[{within}]" if self.cuts else ".+", re.S)
        self._number_symbols(longer)
        self._forget()

    def _forget(self) -> None:
        """The table of known segments: sorted hashes, and where in `pool` the ids of each begin and how many they are."""
        self.hashes = np.zeros(0, np.uint64)
        self.places, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def _number_symbols(self, longer: list[str]) -> None:
        """The pairs of symbols that make a piece, sorted, with the piece and its score.

        A symbol is known by the id of its piece; a character that is none but occurs in pieces has a number behind those.
        """
        extra = sorted({c for p in longer for c in p} - set(self.ids))
        number = self.ids | {c: len(self.pieces) + i for i, c in enumerate(extra)}
        pairs = {}
        for piece in longer:
            for cut in range(1, len(piece)):
                left, right = number.get(piece[:cut]), number.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = self.ids[piece]
        self.pair_keys = np.array(sorted(pairs) or [-1], np.int64)
        self.pair_pieces = np.array([pairs.get(k, 0) for k in self.pair_keys.tolist()], np.int32)
        self.pair_scores = np.array(self.scores, np.float32)[self.pair_pieces]
        chars = [c for c in number if len(c) == 1]
        self.char_ids = np.full(0x110000, self._other, np.int32)
        self.char_ids[[ord(c) for c in chars]] = [number[c] for c in chars]
        self.char_ids[ord(" ")] = self.char_ids[ord(SPACE)]
        self.side_by_side = UNUSED not in self.types

    #: Number of every character that no piece holds.
    _other = (1 << 31) - 1

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score, piece) of pairs of symbols; minus infinity where they make no piece or a place is empty (-1)."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        found = (self.pair_keys[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(found, self.pair_scores[at], -np.inf), self.pair_pieces[at]

    def _new(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pool, places, counts): the ids of segments of UTF-8 bytes; the short ones are merged side by side."""
        data = data[_ranges(starts, ends - starts)]
        ends = np.cumsum(ends - starts)
        # Characters begin at the bytes that do not continue one.
        until = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[np.concatenate([[0], ends])]
        lengths = np.diff(until)
        text = data.tobytes().decode()
        chars = np.frombuffer(text.encode("utf-32-le"), "<u4")
        pools, size = [], 0
        places, counts = np.zeros(len(ends), np.int64), np.full(len(ends), -1)
        order = np.argsort(lengths, kind="stable")
        order = order[(lengths[order] <= SEGMENT_CHARS) & self.side_by_side]
        for at in range(0, len(order), 1 << 14):
            rows = order[at : at + (1 << 14)]
            symbols, left = self._merged_rows(chars[_ranges(until[rows], lengths[rows])], lengths[rows])
            plain = (symbols < len(self.pieces)).all(axis=1)
            pools.append(symbols[symbols >= 0])
            places[rows] = size + np.cumsum(left) - left
            counts[rows[plain]] = left[plain]
            size += len(pools[-1])
        for i in np.flatnonzero(counts < 0).tolist():  # long ones, and those with symbols that are no pieces
            pools.append(np.array(self.segment_ids(text[until[i] : until[i + 1]].replace(" ", SPACE)), np.int32))
            places[i], counts[i] = size, len(pools[-1])
            size += len(pools[-1])
        return np.concatenate([np.zeros(0, np.int32), *pools]), places, counts

    def _merged_rows(self, chars: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of each segment, one row each, -1 where one was merged away or none ever was; and their number."""
        width = int(lengths.max()) + 1  # the last place of a row is never a symbol
        symbols = np.full((len(lengths), width), -1, np.int32)
        symbols[np.arange(width) < lengths[:, None]] = self.char_ids[chars]
        scores, pieces = self._pairs(symbols[:, :-1], symbols[:, 1:])  # of the pair that begins at a place
        # Flat places from here on: a merge touches three places of a row, whatever its width.
        symbols, left = symbols.ravel(), lengths.copy()
        before, behind = np.arange(len(symbols)) - 1, np.arange(len(symbols)) + 1
        before[::width] = width - 1  # an empty place
        pieces = np.concatenate([pieces, np.zeros((len(lengths), 1), np.int32)], axis=1).ravel()
        rows = np.arange(len(lengths))
        while len(rows):
            best = scores.argmax(axis=1)  # of equals the leftmost
            more = scores[np.arange(len(rows)), best] > -np.inf
            if not more.all():
                rows, scores, best = rows[more], scores[more], best[more]
            base, line = rows * width, np.arange(len(rows))
            at = base + best
            gone = behind[at]
            after = behind[gone]
            symbols[at] = pieces[at]
            symbols[gone] = -1
            behind[at] = after
            before[after] = at
            scores[line, gone - base] = -np.inf
            left[rows] -= 1
            scores[line, best], pieces[at] = self._pairs(symbols[at], symbols[after])
            front = before[at]
            inner = np.flatnonzero(front >= base)
            inner = inner[best[inner] > 0]
            front = front[inner]
            scores[inner, front - base[inner]], pieces[front] = self._pairs(symbols[front], symbols[at[inner]])
        return symbols.reshape(len(lengths), width), left

    def merged(self, text: str) -> list[str]:
        """The symbols that are left when no pair of neighbours is a piece any more."""
        symbols: list[str] = list(text)
        before, behind = list(range(-1, len(text) - 1)), [*range(1, len(text)), -1]
        agenda: list[tuple[float, int, int, int]] = []
        apart: dict[str, tuple[str, str]] = {}
        ids, scores, types = self.ids, self.scores, self.types

        def propose(left: int, right: int) -> None:
            if left < 0 or right < 0:
                return
            piece = symbols[left] + symbols[right]
            found = ids.get(piece)
            if found is not None:
                heapq.heappush(agenda, (-scores[found], left, right, len(piece)))
                if types[found] == UNUSED:
                    apart[piece] = symbols[left], symbols[right]

        for i in range(len(symbols) - 1):
            propose(i, i + 1)
        while agenda:
            _, left, right, size = heapq.heappop(agenda)
            if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != size:
                continue  # one of the two has been merged since
            symbols[left] += symbols[right]
            symbols[right] = ""
            behind[left] = behind[right]
            if behind[left] >= 0:
                before[behind[left]] = left
            propose(before[left], left)
            propose(left, behind[left])
        return [part for s in symbols if s for part in self._used(s, apart)]

    def _used(self, symbol: str, apart: dict[str, tuple[str, str]]) -> Iterator[str]:
        """A piece marked as unused is taken apart again into what it was merged from."""
        todo = [symbol]
        while todo:
            s = todo.pop()
            if s in apart:
                todo += reversed(apart[s])
            else:
                yield s

    def segment_ids(self, segment: str) -> list[int]:
        """The ids of a segment."""
        out: list[int] = []
        for symbol in self.merged(segment):
            found = self.ids.get(symbol)
            if found is not None:
                out.append(found)
            elif self.bytes:
                out += [self.bytes[b] for b in symbol.encode()]
            else:
                out.append(self.unknown)
        return out

    def text_ids(self, text: str) -> list[int]:
        """The ids of one text without its end, every segment merged anew."""
        text = text.replace(" ", SPACE)
        ids = [i for s in self.segment.findall(SPACE + text if text and self.dummy_prefix else text) for i in self.segment_ids(s)]
        return ids if self.bytes else [i for i, before in zip(ids, [-1, *ids]) if i != self.unknown or before != i]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts without their ends, one after the other, and the n + 1 places where those of a text begin."""
        front = b" " if self.dummy_prefix else b""
        rows = [front + t.replace(SPACE, " ").encode() if t else b"" for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        data = np.frombuffer(b"".join(rows), np.uint8)
        if not len(data):
            return np.zeros(0, np.int32), offsets
        begins = np.zeros(len(data), bool)
        if self.cuts:
            space, alone = data == 32, self.alone[data]
            begins[1:] = (space[1:] & ~space[:-1]) | alone[1:] | alone[:-1]
        begins[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))
        hashes, example, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), bool)
        known[at < len(self.hashes)] = self.hashes[at[at < len(self.hashes)]] == hashes[at < len(self.hashes)]
        new = np.flatnonzero(~known)
        pool, places, counts = self._new(data, starts[example[new]], ends[example[new]])
        places += len(self.pool)
        pool = np.concatenate([self.pool, pool])
        place, count = np.empty(len(hashes), np.int64), np.empty(len(hashes), np.int64)
        place[known], count[known] = self.places[at[known]], self.counts[at[known]]
        place[new], count[new] = places, counts
        sizes = count[which]
        ids = pool[_ranges(place[which], sizes)]
        until = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(starts, offsets)]
        if not self.bytes:  # unknown neighbours are one piece, over segments too
            again = np.zeros(len(ids) + 1, bool)
            again[1:-1] = (ids[1:] == self.unknown) & (ids[:-1] == self.unknown)
            again[until[:-1]] = False
            again = again[:-1]
            ids, until = ids[~again], until - np.concatenate([[0], np.cumsum(again)])[until]
        self._remember(hashes[new], places, counts, pool)
        return ids, until

    def _remember(self, hashes: np.ndarray, places: np.ndarray, counts: np.ndarray, pool: np.ndarray) -> None:
        """Put new segments into the table; a full one is begun anew."""
        if len(self.hashes) + len(hashes) > SEGMENTS or len(pool) > 16 * SEGMENTS:
            self._forget()
            return
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.pool = np.insert(self.hashes, at, hashes), pool
        self.places, self.counts = np.insert(self.places, at, places), np.insert(self.counts, at, counts)

    def surface(self, i: int) -> bytes:
        """The bytes that a piece stands for."""
        if self.types[i] == CONTROL:
            return b""
        if self.types[i] == UNKNOWN:
            return " ⁇ ".encode()
        return bytes([int(self.pieces[i][3:5], 16)]) if self.types[i] == BYTE else self.pieces[i].replace(SPACE, " ").encode()

    def decode(self, ids: list[int]) -> str:
        """The text of ids; each byte of a run of byte pieces that is not UTF-8 becomes U+FFFD."""
        out, run = [], b""
        for i in [*ids, self.end]:
            if self.types[i] == BYTE:
                run += self.surface(i)
                continue
            out.append(_utf8(run))
            run = b""
            out.append(self.surface(i).decode())
        text = "".join(out)
        first = next((i for i in ids if self.types[i] != CONTROL), None)
        spaced = self.dummy_prefix and first is not None and self.types[first] in (NORMAL, UNUSED) and self.pieces[first].startswith(SPACE)
        return text[1:] if spaced else text


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, `size` numbers long, one after the other."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def _utf8(run: bytes) -> str:
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(run):
            for size in (1, 2, 3, 4):
                try:
                    out.append(run[at : at + size].decode())
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a model file; ValueError where its kind is not supported."""
    pieces, scores, types, prefix = [], [], [], True
    with open(path, "rb") as file:
        model = file.read()
    for number, value in _fields(model):
        if number == 1:
            piece = dict(_fields(value))
            pieces.append(piece[1].decode())
            scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            types.append(piece.get(3, NORMAL))
        elif number == 2:
            spec = dict(_fields(value))
            if spec.get(3, 1) != 2 or spec.get(24, 0):
                raise ValueError("not a merge-type vocabulary with spaces in front of words")
        elif number == 3:
            spec = dict(_fields(value))
            if spec.get(2) or spec.get(4, 1) or not spec.get(5, 1):
                raise ValueError("only texts that are not normalised, spaces escaped, are supported")
            prefix = bool(spec.get(3, 1))
    if USER_DEFINED in types:
        raise ValueError("user-defined symbols are not supported")
    return Vocabulary(pieces, scores, types, prefix)


@lru_cache(maxsize=4)
def _library(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _slices(texts) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of an Arrow column, a bounded number of characters at a time."""
    at, n = 0, len(texts)
    while at < n:
        part, chars = [], 0
        while at + len(part) < n and (not part or chars < SLICE):
            part.append(texts[at + len(part)].as_py() or "")
            chars += len(part[-1])
        yield at, part
        at += len(part)


def _compared(v: Vocabulary, texts: list[str], flat: np.ndarray, until: np.ndarray, theirs: list[list[int]]):
    """(ids, places, whether the library's ids are the same); texts where they are not are encoded once more."""
    sizes = np.array([len(t) for t in theirs])
    other = np.fromiter(chain.from_iterable(theirs), np.int32, int(sizes.sum()))
    same = np.ones(len(texts), bool)
    if not np.array_equal(other, flat) or not np.array_equal(sizes, np.diff(until)):
        rows = [flat[a:b] for a, b in zip(until[:-1], until[1:])]
        for i, t in enumerate(theirs):
            if rows[i].tolist() != t:
                rows[i] = np.array([*v.text_ids(texts[i]), v.end], np.int32)
                same[i] = rows[i].tolist() == t
        flat, until = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    return flat, until, same


def encode(docs: DataFrame, model: str, text: str = "text", ids: str = "ids", agrees: str | None = "agrees") -> DataFrame:
    """`docs` with `ids`, the piece ids of each text and the end id.

    `agrees` names a column that says whether the sentencepiece library, run over the same Arrow batch,
    gives the same ids; None leaves the comparison out.
    """
    import pyarrow as pa

    extra = [T.StructField(ids, T.ArrayType(T.IntegerType(), False))]
    if agrees:
        extra.append(T.StructField(agrees, T.BooleanType()))
    names = {f.name.lower() for f in extra}
    keep = [f for f in docs.schema.fields if f.name.lower() not in names]
    # The text goes along under a name of its own, cleaned of what is not UTF-8.
    source = "__text"
    while source in {f.name.lower() for f in keep}:
        source += "_"
    columns = [F.col("`" + f.name.replace("`", "``") + "`") for f in keep]
    wanted = F.make_valid_utf8(F.col("`" + text.replace("`", "``") + "`").cast("string")).alias(source)

    def run(batches):
        v = vocabulary(model)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            rest = batch.select(range(batch.num_columns - 1))
            for at, part in _slices(texts):
                flat, until = v.encode(part)
                flat = np.insert(flat, until[1:], v.end)
                until = until + np.arange(len(until))
                if agrees:
                    theirs = _library(model).encode(part, add_eos=True, num_threads=1)
                    flat, until, same = _compared(v, part, flat, until, theirs)
                lists = pa.ListArray.from_arrays(pa.array(until.astype(np.int32)), pa.array(flat))
                columns = [*rest.slice(at, len(part)).columns, lists]
                if agrees:
                    columns.append(pa.array(same))
                yield pa.RecordBatch.from_arrays(columns, [*rest.schema.names, *[f.name for f in extra]])

    return docs.select(*columns, wanted).mapInArrow(run, T.StructType([*keep, *extra]))


def decode(coded: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """`coded` with `text`, what the library's decode() gives for its `ids`; null ids give the empty text."""
    import pyarrow as pa

    keep = [f for f in coded.schema.fields if f.name.lower() != text.lower()]
    at = [f.name for f in keep].index(ids)

    def run(batches):
        v = vocabulary(model)
        surfaces = pa.array([v.surface(i) for i in range(len(v.pieces))], pa.large_binary())
        control = np.array(v.types) == CONTROL
        spaced = np.array([t in (NORMAL, UNUSED) and p.startswith(SPACE) for p, t in zip(v.pieces, v.types)]) & v.dummy_prefix
        for batch in batches:
            sizes = np.cumsum(batch.column(at).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            begin = 0
            while begin < batch.num_rows:
                ahead = sizes[begin - 1] if begin else 0
                to = max(begin + 1, int(np.searchsorted(sizes, ahead + SLICE, side="right")))
                part = batch.slice(begin, to - begin)
                texts = pa.array(_decoded(v, surfaces, control, spaced, *_flat(part.column(at))), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*batch.schema.names, text])
                begin = to

    columns = [F.col("`" + f.name.replace("`", "``") + "`") for f in keep]
    return coded.select(*columns).mapInArrow(run, T.StructType([*keep, T.StructField(text, T.StringType())]))


def _decoded(v: Vocabulary, surfaces, control: np.ndarray, spaced: np.ndarray, flat: np.ndarray, offsets: np.ndarray) -> list[str]:
    """The texts of rows of ids: the pieces' bytes back to back, read as UTF-8."""
    import pyarrow as pa

    whole = surfaces.take(pa.array(flat))
    ends = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(flat) + 1]
    data = whole.buffers()[2]
    data = memoryview(data) if data is not None else memoryview(b"")
    controls = np.flatnonzero(control[flat])
    texts = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        while b > a and control[flat[b - 1]]:
            b -= 1
        if a == b:
            texts.append("")
            continue
        marks = np.searchsorted(controls, [a, b])
        try:
            if marks[0] != marks[1]:
                raise ValueError  # control pieces part runs of bytes
            out = str(data[ends[a] : ends[b]], "utf-8")
            texts.append(out[1:] if spaced[flat[a]] else out)
        except ValueError:
            texts.append(v.decode(flat[a:b].tolist()))
    return texts


def _flat(lists) -> tuple[np.ndarray, np.ndarray]:
    """The values of an Arrow list column and the n + 1 offsets of its rows (null: empty)."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    offsets = np.zeros(len(lists) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    return pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.int32), offsets
