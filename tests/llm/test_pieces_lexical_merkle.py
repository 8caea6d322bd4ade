"""SentencePiece agenda, ranked lexical search and the Merkle manifest, against the library and brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tablelens.llm import lexical, merkle, pieces, queries, sql

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  two  spaces ", "tab\tline\nend\r\n", "▁▁ literal ▁x▁", "é漢字😀\x00z", "<s></s><unk><0x41>", "ﬁ½①",
    "a" * 5000, "漢字かな" * 300, "x y " * 3000, "0123456789", " あ", " \n \n", "Ünïcödé " * 40,
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_agenda_equals_the_library_on_random_texts(library):
    rng = random.Random(5)
    letters = [*map(chr, range(32, 127)), *"\t\n\r\x00é▁▁▁漢字😀 ", *" " * 30]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(3000)]
    v = pieces.vocabulary(MODEL)
    for _ in range(2):  # new segments, then known ones
        ids, until = v.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(until[:-1], until[1:])] == library.encode(texts)
    assert [v.text_ids(t) for t in texts[:300]] == library.encode(texts[:300])


def test_results_do_not_depend_on_the_table_of_segments(library, monkeypatch):
    monkeypatch.setattr(pieces, "SEGMENTS", 10)
    monkeypatch.setattr(pieces, "SEGMENT_CHARS", 6)
    v = pieces.vocabulary.__wrapped__(MODEL)
    texts = [t or "" for t in ODD] + ["the quick brown foxes jump over understanding"] * 3
    ids, until = v.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(until[:-1], until[1:])] == library.encode(texts)


def test_decoding_equals_the_library_on_any_ids(library):
    rng = random.Random(6)
    v = pieces.vocabulary(MODEL)
    for _ in range(2000):
        ids = [*rng.choices(range(32000), k=rng.randint(0, 5)), *rng.choices(range(262), k=rng.randint(0, 6))]
        rng.shuffle(ids)
        assert v.decode(ids) == library.decode(ids)


def test_encode_and_decode_tables(spark, library):
    rows = [(i if i != 3 else None, t, "kept", i) for i, t in enumerate(ODD)] + [(0, "again", "x", 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, __text string, IDS long").repartition(3)
    out = pieces.decode(pieces.encode(docs, MODEL), MODEL)
    assert [c for c in out.columns if c.lower() == "ids"] == ["ids"]
    got = [(r.doc_id is None, r.doc_id, r.text, r.ids, r.decoded, r.agrees, r["__text"]) for r in out.collect() if r.doc_id is not None]
    want = []
    for i, t, other, _ in rows:
        ids = library.encode(t or "", add_eos=True)
        if i is not None:
            want.append((False, i, t, ids, library.decode(ids), True, other))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert out.where("doc_id is null").count() == 1
    assert pieces.encode(docs, MODEL, agrees=None).columns == ["doc_id", "text", "__text", "ids"]
    empty = pieces.decode(pieces.encode(docs.limit(0), MODEL), MODEL)
    assert empty.collect() == []
    broken = spark.sql("select 1L as doc_id, cast(X'61FF62' as string) as text")
    assert pieces.decode(pieces.encode(broken, MODEL), MODEL).first().decoded == "a�b"


def test_null_ids_decode_to_the_empty_text(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [2]), (4, [264, 2])], "k long, ids array<int>")
    assert [r.decoded for r in pieces.decode(df, MODEL).orderBy("k").collect()] == ["", "", "", "a"]


def test_a_text_that_differs_is_encoded_once_more():
    v = pieces.vocabulary(MODEL)
    right = [*v.text_ids("hello there"), v.end]
    wrong = np.array([*right[:-1], 5, v.end], np.int32)
    flat, until, same = pieces._compared(v, ["hello there"], wrong, np.array([0, len(wrong)]), [right])
    assert flat.tolist() == right and until.tolist() == [0, len(right)] and same.tolist() == [True]


def test_piece_query(spark, sf, library):
    texts = {r.doc_id: r.text for r in queries.table(spark, sf, "documents").collect()}
    hexed = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in queries.op11(spark, sf).collect():
        ids = library.encode(texts[r.doc_id] or "", add_eos=True)
        assert tuple(r) == (r.doc_id, len(ids), hexed(" ".join(map(str, ids))), hexed(library.decode(ids)), True)


# --- ranked lexical search -----------------------------------------------


def ranked_brute(docs, items, k):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(lower))
    counted = [(d, Counter(terms(t))) for d, t in docs]
    total, length = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in counted:
            if not c:
                continue
            m, score = 75 + (25 * sum(c.values()) * total) // length, 0
            for t in terms(text):
                if c[t]:
                    score += math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
            if score:
                found.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(found, key=lambda f: f[:3])[:k])]
    return out


def test_ranked_search_equals_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)] + ["é", "漢字", "The", "x-ray", "3.14"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randint(0, 60)))) for i in range(400)]
    docs += [(None, "w1 w2 w3"), (7, "w1 w2 w3"), (7, "w1 w2 w3"), (900, None), (901, ""), (902, "... --"), (903, "w0 " * 9000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(12)]
    items += [(3, "w1 w1 w2"), (None, "w5"), (50, None), (51, ""), (52, "nowhere at all")]
    left = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n", "2 as terms", "3 as score").repartition(5)
    right = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "0 as rank")
    for block in (lexical.BLOCK_CHARS, 40):  # all queries at once, then block after block
        monkeypatch.setattr(lexical, "BLOCK_CHARS", block)
        got = [tuple(r) for r in lexical.ranked(left, right, k=5).collect()]
        assert sorted(got, key=str) == sorted(ranked_brute(docs, items, 5), key=str)
    assert lexical.ranked(left.limit(0), right).collect() == []
    assert lexical.ranked(left, right.limit(0)).collect() == []


def test_accumulators_are_limited_and_nothing_is_lost():
    rng = np.random.default_rng(2)
    n_docs, n_terms = 5000, 12
    held = rng.random((n_docs, n_terms)) < np.array([0.004] * 4 + [0.3] * 4 + [0.9] * 4)
    docs, terms = np.nonzero(held)
    counts, n = rng.integers(1, 4, len(docs)), rng.integers(5, 80, n_docs)
    shard = lexical.Shard(n, docs, terms.astype(np.int32), counts, n_terms, n_docs, int(n.sum()))
    df = held.sum(0)
    weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df]
    asked = sorted(((t, weights[t]) for t in range(n_terms)), key=lambda q: df[q[0]])
    exact = np.zeros(n_docs, np.int64)
    for t, w in asked:
        a, b = shard.begins[t], shard.begins[t + 1]
        exact[shard.docs[a:b]] += w * shard.adds[a:b]
    for _ in range(2):  # the shard is as before afterwards
        found, scores, number = shard.top(asked, 5)
        assert number < n_docs // 10
        assert (scores == exact[found]).all()
        assert sorted(scores)[-5:] == sorted(exact)[-5:]


def test_lexical_query_equals_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = sorted(tuple(r) for r in queries.op12(spark, sf).collect())
    assert got == sorted(con.sql(sql.OP12).fetchall()) and got


# --- Merkle manifest -----------------------------------------------------


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field_text(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def manifest_brute(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0], digest(*map(field_text, r)), r))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in langs:
        groups[g].sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1]))
        trees[g] = tree([t[1] for t in groups[g]])
    top = tree([trees[g][-1][0] for g in langs])
    out = []
    for at, g in enumerate(langs):
        for i, (k, leaf, r) in enumerate(groups[g]):
            node, siblings = leaf, []
            if k is not None and zlib.crc32(str(k).encode()) % 3 == 0:
                node = digest(*map(field_text, (*r[:4], r[4] and r[4].translate(lower))))
            for levels, place in ((trees[g], i), (top, at)):
                for level in levels[:-1]:
                    run, a = level[place // 8 * 8 : place // 8 * 8 + 8], place % 8
                    siblings += run[:a] + run[a + 1 :]
                    node, place = digest(*run[:a], node, *run[a + 1 :]), place // 8
            out.append((k, leaf, trees[g][-1][0], top[-1][0], digest(*siblings), node, node == top[-1][0]))
    return out


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def rows_of(n, langs, rng):
    return [(i if i % 17 else None, f"s{i % 3}", rng.choice(langs), i % 7 or None, None if i % 11 == 0 else f"Text {i} É") for i in range(n)]


@pytest.mark.parametrize(
    "n, langs", [(0, ["a"]), (1, [None]), (8, ["a"]), (65, ["a"]), (700, ["a"] * 6 + ["b", None, "", "Z", "é"]), (300, [f"l{i}" for i in range(70)] + ["x"] * 60)]
)
def test_manifest_equals_brute_force(spark, n, langs):
    rows = rows_of(n, langs, random.Random(n))
    rows += rows[:3] * 20  # repeated rows
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as leaf", "2 as grp", "3 as pos", "4 as row").repartition(3)
    got = merkle.manifest(df, FIELDS, levels=1).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, manifest_brute(rows)))


def test_manifest_query(spark, sf):
    rows = [tuple(r[c] for c in FIELDS) for r in queries.table(spark, sf, "documents").collect()]
    assert sorted(map(str, map(tuple, queries.op13(spark, sf).collect()))) == sorted(map(str, manifest_brute(rows)))


def test_long_fan_outs_go_in_stretches(spark, monkeypatch):
    """A short last subtree serves all partners of its whole neighbours."""
    monkeypatch.setattr(merkle, "STRETCH", 3)
    rows = rows_of(8 * 8 * 8 * 2 + 1, ["a"], random.Random(1))
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA), FIELDS, levels=1).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, manifest_brute(rows)))
