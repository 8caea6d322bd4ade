"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelens.llm import debruijn, decontaminate, katz, packing, pii, quality, queries, simhash, topk, toxicity, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, start int, key string, fp int"


def awkward(spark, rows):
    """Documents with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", None, 0.5, 1, "k", 2) for i, t in rows], DOCS)


def words(n, seed=0):
    g = random.Random(seed)
    return " ".join("".join(g.choice("abcdefgh") for _ in range(g.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    long = words(30_000, 1)
    copy = words(60, 2)
    return awkward(spark, [(1, None), (2, ""), (3, " \t\n"), (None, copy), (5, copy), (6, copy), (6, copy), (7, long), (8, "é" * 50), (9, "x" * 100_000), (10, copy.replace("a", "b", 1))])


@pytest.fixture(scope="module")
def none(spark):
    return awkward(spark, [])


def marks(spark, rows, name):
    return spark.createDataFrame(rows, f"doc_id long, {name} int")


# fingerprints


def linked(fps, bits):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(root, 2):
        if (a ^ b).bit_count() <= bits:
            root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_anchors_meet_all_close_fingerprints(spark):
    g = random.Random(3)
    fps = []
    for _ in range(60):
        base = g.getrandbits(64)
        fps += [base] + [base ^ sum(1 << b for b in g.sample(range(64), k)) for k in (1, 2, 3, 3, 4)]
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long").distinct()
    nodes = df.select(F.col("fp").alias("node"), F.col("fp").alias("rank"))
    got = {r.node & (2**64 - 1): r.top for r in simhash.components(simhash.links(df), nodes).collect()}
    want = linked(fps, 3)
    groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    assert groups(got) == groups(want)


def test_large_anchors_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 4)
    base = 0x0123456789ABCDEF
    fps = [base ^ (1 << b) for b in range(40)]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    nodes = df.select(F.col("fp").alias("node"), F.col("fp").alias("rank"))
    assert {r.root for r in simhash.components(simhash.links(df), nodes).collect()} == {min(fps)}


def test_simhash_on_awkward_rows(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 11
    got = {(r.doc_id, r.fp): r.component_id for r in rows}
    assert {v for (i, f), v in got.items() if f == 0} == {1}  # null, empty and blank
    assert {v for (i, _), v in got.items() if i in (None, 5, 6)} == {5}
    assert simhash.near_duplicates(none).collect() == []


def test_one_of_each_keeps_columns_and_one_row(spark, odd, none):
    clashing = odd.withColumn("id", F.lit("mine")).withColumn("text_hash", F.lit(1.5)).withColumn("__id", F.lit("own"))
    out = simhash.one_of_each(clashing)
    assert out.columns == clashing.columns
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == sorted({r.component_id for r in simhash.near_duplicates(odd).collect()})
    assert {(r.id, r.text_hash, r["__id"]) for r in rows} == {("mine", 1.5, "own")}
    assert simhash.one_of_each(none).collect() == []


def test_one_of_each_equals_brute_force(spark):
    rows = []
    for k in range(60):
        base = words(120, 400 + k).split()
        for change in range(3):
            rows.append((len(rows), " ".join([*base[: 120 - change], *["new"] * change])))
    rows += [(len(rows), rows[0][1]), (len(rows) + 1, rows[0][1]), (None, rows[0][1]), (None, "alone")]
    kept = simhash.one_of_each(awkward(spark, rows)).collect()
    fps = [simhash.fingerprint_of([w.encode() for w in t.lower().split()]) for _, t in rows]
    group = linked(fps, 3)
    want = {}
    for (i, _), fp in zip(rows, fps):
        best = want.get(group[fp], 1 << 62)
        want[group[fp]] = min(best, (1 << 61) if i is None else i)
    assert sorted((1 << 61) if r.doc_id is None else r.doc_id for r in kept) == sorted(want.values())


def test_decontamination_with_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text, "a"), (2, "other words here", "b"), (None, None, "c")], "doc_id long, text string, __id string")
    docs = docs.withColumn("id", F.lit(1)).withColumn("text_hash", F.lit(2))
    out = decontaminate.decontaminated(docs, spark.createDataFrame([(1, text)], "item_id long, text string"))
    assert out.columns == docs.columns and sorted(r["__id"] for r in out.collect()) == ["b", "c"]


# packing


def test_packing_is_gapless_and_complete(spark, odd, none):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    extra = [(20, "  two  spaces \n\n and\ttabs "), (21, "a<|endoftext|>b c"), (22, " lead"), (23, "it's 12,000 ünïcödé…  \u2003x"), (24, "a\u00a0 b \x1c c")]
    docs = odd.union(awkward(spark, extra))
    rows = packing.pack(docs, path, size=64, block_tokens=500).collect()
    tok = Tokenizer.from_file(path)
    want = sorted((r.doc_id or -1, np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [1], np.uint32).tobytes()) for r in docs.collect())
    pieces, got = {}, []
    for r in rows:
        assert r.length * 4 == len(r.ids)
        pieces.setdefault(r.doc_id, []).append(r)
    for i, ps in pieces.items():
        ps.sort(key=lambda r: r.start)
        copies = {1: 1, 6: 2}.get(i, 1)
        whole = b"".join(p.ids for p in ps) if copies == 1 else None
        if whole is not None:
            got.append((i or -1, whole))
    assert sorted(got) == [w for w in want if w[0] != 6]
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at == 64 or (at < 64 and at & (at - 1) == 0)
    assert packing.pack(none, path).collect() == []


def test_assignment_prefers_the_cheapest_open_sequence():
    pieces, rest = packing.assign([100, 60, 60, 30, 30, 20], 100, 1.0, 0.01)
    placed = {}
    for d, start, n, k, offset in pieces:
        placed.setdefault(k, []).append((offset, n))
    assert all(sum(n for _, n in p) == 100 for p in placed.values()) and len(placed) == 3
    assert rest == [] and [p for p in pieces if p[0] == 0] == [(0, 0, 100, 0, 0)]


# URLs


def test_url_rules_and_parts(spark):
    pages = spark.createDataFrame(
        [(1, "http://Example.COM/en/1"), (2, "https://www.example.com/en/2?x#y"), (3, "http://m.a.net/fr/x"), (4, None), (5, "no scheme"), (6, "x://h#f"), (7, "ftp://q.org?a"), (8, "http://notcom/a"), (1, "http://com"), (9, "http://a://b/c")],
        "page_id long, url string",
    ).withColumn("host", F.lit("clash"))
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages, labels, queries.URL_RULES).collect()), key=str)
    assert (1, "example.com", "/en/1", "example.com/en/", "block") in got
    assert (2, "www.example.com", "/en/2", "www.example.com/en/", "allow") in got
    assert (3, "m.a.net", "/fr/x", "net/fr/", "block") in got
    assert [g for g in got if g[0] in (4, 5)] == [(4, "", "", None, "allow"), (5, "", "", None, "allow")]
    assert (6, "h", "", None, "allow") in got and (7, "q.org", "", None, "allow") in got and (8, "notcom", "/a", None, "allow") in got
    assert (1, "com", "", None, "allow") in got and (9, "a:", "//b/c", None, "allow") in got
    assert urls.judge_urls(pages.limit(0), labels, queries.URL_RULES).collect() == []


def test_templates_merge_similar_branches_and_reject_impure_ones(spark):
    rows = [(i, f"http://h.org/u{'abcdefghijklmnopqrstuvwxyz'[i % 26]}/{i}") for i in range(260)] + [(1000 + i, f"http://h.org/junk/{i}.html") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, _ in rows], "doc_id long, quality int")
    got = {r.page_id: r for r in urls.judge_urls(pages, labels, []).collect()}
    assert got[5].template == "/*/*" and got[5].verdict == "allow"
    assert got[1005].template == "/junk/*.html" and got[1005].verdict == "block"


def test_few_similar_branches_are_merged_as_many_are(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, f"http://h.org/good/{letters[i % 3]}{letters[i // 3 % 26]}x/p") for i in range(90)] + [(100 + i, f"http://h.org/spam/{c}q") for i, c in enumerate(letters[:15])]
    rows += [(200 + i, f"http://two.org/{'ab'[i % 2]}x/p") for i in range(40)] + [(300 + i, f"http://two.org/{'cd'[i % 2]}x/p") for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i < 100 or 200 <= i < 300)) for i, _ in rows], "doc_id long, quality int")
    got = {r.page_id: r for r in urls.judge_urls(pages, labels, []).collect()}
    assert {got[100 + i].verdict for i in range(15)} == {"block"} and {got[100 + i].template for i in range(15)} == {"/spam/*"}
    assert {got[i].verdict for i in range(90)} == {"allow"}
    assert {(got[i].template, got[i].verdict) for i in range(200, 240)} == {("/*#+/p", "allow")}
    assert {(got[i].template, got[i].verdict) for i in range(300, 340)} == {("/*#-/p", "block")}


# personal data


def test_pseudonyms_keep_format_and_links(spark):
    text = "card 4041894974608795 or 4041-8949-7460-8795, +1 (988) 555-2485, ab.42@mail8.example.com, 70.123.182.155, 2020-02-29 and 29.02.2020, 078-05-1120"
    docs = spark.createDataFrame([(1, text), (2, "again 4041894974608795"), (3, None), (4, ""), (5, "4041894974608796 300.1.1.1 30/30/2000 666-12-1234 v1.2")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.pseudonymize(docs, "k").collect()}
    assert got[3] is None and got[4] == "" and got[5] == "4041894974608796 300.1.1.1 30/30/2000 666-12-1234 v1.2"
    for value in ("4041894974608795", "4041-8949-7460-8795", "988", "ab.42@", "70.123.182.155", "2020-02-29", "29.02.2020", "078-05-1120"):
        assert value not in got[1]
    plain = got[2].split()[1]
    assert plain in got[1] and "-".join(plain[i : i + 4] for i in range(0, 16, 4)) in got[1]
    digits = [int(c) for c in plain[::-1]]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    y, m, d = got[1].split(", ")[4].split(" and ")[0].split("-")
    assert f"{d}.{m}.{y}" in got[1]
    other = pii.pseudonymize(docs, "other").where("doc_id = 2").first().text
    assert other != got[2]


def _luhn(d):
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, d[::-1]))) % 10 == 0


def _brute_cards(groups):
    """(first, last) of valid cards, by trying everything from the left, the longest first."""
    out, at = [], 0
    while at < len(groups):
        ends = [j for j in range(len(groups), at, -1) if 13 <= len("".join(groups[at:j])) <= 19 and _luhn("".join(groups[at:j]))]
        if ends:
            out.append((at + 1, ends[0]))
        at = ends[0] if ends else at + 1
    return out


def test_cards_equal_brute_force(spark):
    g = random.Random(11)
    rows = []
    for _ in range(400):
        groups = ["".join(g.choice("0123456789") for _ in range(g.choice([1, 2, 3, 4, 4, 4, 5, 6, 13, 16]))) for _ in range(g.randint(1, 9))]
        rows.append((groups,))
    got = spark.createDataFrame(rows, "groups array<string>").select("groups", pii.cards_in(F.col("groups")).alias("c")).collect()
    assert sum(len(r.c) for r in got) > 50
    for r in got:
        assert [tuple(x) for x in r.c] == _brute_cards(r.groups)


def test_every_length_and_grouping_of_cards_is_found(spark):
    g = random.Random(12)
    rows, plain = [], []
    around = ["{}", "card {} 12/25", "{} 123", "7 {}", "{}/25", "{} 2020-02-29", "{} 12/25/2024.", "no {}, {}", "078-05-1120 {}"]
    for length in range(13, 20):
        for shape in range(9):
            body = "".join(g.choice("123456789") for _ in range(length - 1))
            number = next(body + c for c in "0123456789" if _luhn(body + c))
            cuts = sorted(g.sample(range(4, length), shape % 4))
            shown = g.choice(" -").join(number[a:b] for a, b in zip([0, *cuts], [*cuts, length]))
            plain.append((number, shown))
            rows.append((len(rows), around[shape].replace("{}", shown)))
    got = {r.i: r.t for r in pii.pseudonymize(spark.createDataFrame(rows, "i long, t string"), "k", "t").collect()}
    for i, t in rows:
        assert plain[i][1] not in got[i] and [c for c in got[i] if not c.isdigit()] == [c for c in t if not c.isdigit()], (t, got[i])
        if "12/25/2024" in t:
            assert "12/25/2024" not in got[i]
        if "078-05-1120" in t:
            assert "078-05-1120" not in got[i]


def test_bare_phones_runs_and_odd_rows(spark):
    long = "1 " * 20_000 + "9" * 30_000 + " call 9885552485"
    rows = [(1, "call 9885552485 or 988-555-2485 or +19885552485"), (2, "1700000000 0123456789 12345678901234567890123"), (3, long), (3, long), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("groups", F.lit(1)).withColumn("m", F.lit("x"))
    out = pii.pseudonymize(docs, "k")
    got = [r.text for r in out.orderBy("doc_id").collect()]
    assert out.columns == docs.columns and len(got) == 6
    a, b, c = got[0].split(" or ")
    assert a[5:] == b.replace("-", "") == c[2:] != "9885552485"
    assert got[1] == rows[1][1] and got[4] is None and got[5] == ""
    assert got[2] == got[3] and got[2].endswith(" call " + a[5:]) and "9" * 30_000 in got[2]
    assert pii.pseudonymize(docs.limit(0), "k").collect() == []


def test_feistel_is_a_permutation(spark):
    df = spark.range(7 * 11).select((F.floor(F.col("id") / 11)).cast("long").alias("l"), (F.col("id") % 11).alias("r"))
    out = df.select(pii.feistel(F.col("l"), F.col("r"), F.lit(7), F.lit(11), "k", F.lit("t")).alias("o")).select("o.l", "o.r").collect()
    assert sorted((r.l, r.r) for r in out) == [(a, b) for a in range(7) for b in range(11)]


# decontamination


def brute_tiles(doc, item, least):
    """Greedy string tiling by comparing everything."""
    fa, fb, out = [w != "" for w in doc], [True] * len(item), []
    while True:
        best = []
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and fa[i + n] and fb[j + n] and doc[i + n] == item[j + n]:
                    n += 1
                if n >= least and (not best or n >= best[0][2]):
                    best = ([] if not best or n > best[0][2] else best) + [(i, j, n)]
        if not best:
            return out
        for i, j, n in best:
            if all(fa[i : i + n]) and all(fb[j : j + n]):
                fa[i : i + n] = fb[j : j + n] = [False] * n
                out.append((i, j, n))


def test_tiles_equal_brute_force():
    g = random.Random(5)
    for _ in range(40):
        doc, item = [g.choice("abc") for _ in range(40)], [g.choice("abc") for _ in range(20)]
        assert decontaminate.tiles(doc, item, 3) == brute_tiles(doc, item, 3)


def test_reordered_passages_are_caught(spark, odd, none):
    item = words(40, 9)
    parts = item.split()
    moved = " ".join(parts[20:] + ["xx"] + parts[:20])
    docs = odd.union(awkward(spark, [(30, words(50, 10) + " " + moved.upper() + "!"), (31, words(80, 11)), (32, " ".join(parts[:8]) + " " + words(30, 12))]))
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "too short")], "item_id long, text string")
    got = decontaminate.contaminated(docs, bench).collect()
    assert [(r.doc_id, r.item_id, r.covered, len(r.tiles)) for r in got] == [(30, 1, 40, 2)]
    left = decontaminate.decontaminated(docs, bench)
    assert left.columns == docs.columns and left.count() == docs.count() - 1
    assert decontaminate.contaminated(none, bench).collect() == [] and decontaminate.contaminated(docs, bench.limit(0)).collect() == []


# toxicity


def test_network_gradients():
    g = np.random.default_rng(1)
    net = toxicity.Network(3, 2)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, mask, d = g.standard_normal((3, 5, toxicity.DIM)), np.ones((3, 5)), g.standard_normal(3)
    mask[1, 3:] = 0
    loss = lambda: float(net.forward(x, mask)[0] @ d)
    grads, d_x = net.gradients(d, net.forward(x, mask, keep=True)[1])
    for target, grad in [*((net.p[k], grads[k]) for k in net.p), (x, d_x)]:
        at = tuple(g.integers(0, n) for n in target.shape)
        before = target[at]
        target[at] = before + 1e-4
        up = loss()
        target[at] = before - 1e-4
        down = loss()
        target[at] = before
        assert np.isclose((up - down) / 2e-4, grad[at], rtol=2e-2, atol=2e-4)


def test_toxicity_learns_and_scores_every_row(spark, odd, none):
    rows = [(100 + i, words(60, 50 + i) + (" zzqidiot " if i % 3 == 0 else " ") + words(60, 500 + i)) for i in range(150)]
    docs = odd.union(awkward(spark, rows))
    model = toxicity.train(docs, marks(spark, [(i, int(i % 3 == 100 % 3)) for i, _ in rows[:90]] + [(None, 1), (1, None)], "toxic"))
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, model).collect()}
    right = sum((got[i] >= 0.3) == (i % 3 == 100 % 3) for i, _ in rows[90:])
    assert right >= 57
    assert toxicity.toxicity(docs, model).count() == 161 and 0 <= got[1] <= 1 and got[1] == got[2] == got[3]
    assert toxicity.without_toxic(docs, model, 0.3).columns == docs.columns
    assert toxicity.toxicity(none, model).collect() == []
    constant = toxicity.train(docs, marks(spark, [], "toxic"))
    assert {r.score for r in toxicity.toxicity(docs, constant).collect()} == {0.0}


def test_toxic_terms_count_anywhere_in_unspaced_and_long_tokens(spark):
    signs = [chr(0x4E00 + k) for k in range(400)]

    def line(seed, term):
        g = random.Random(seed)
        w = [g.choice(signs) for _ in range(40)]
        return "".join(w[:20]) + term + "、" + "".join(w[20:])

    rows = []
    for i in range(300):  # odd ids are toxic; half of the texts have no spaces
        rows.append((i, line(i, "龜龘" if i % 2 else "") if i % 4 < 2 else words(12, i) + (" zzqidiot " if i % 2 else " ") + words(12, 900 + i)))
    glued = [(300 + i, words(6, 50 + i) + " " + "".join(words(12, 70 + i).split()) + ("zzqidiot" if i % 2 else "") + "".join(words(12, 90 + i).split())) for i in range(20)]
    docs = spark.createDataFrame(rows + glued, "doc_id long, text string")
    model = toxicity.train(docs, marks(spark, [(i, i % 2) for i in range(200)], "toxic"))
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, model).collect()}
    assert sum((got[i] >= 0.5) == (i % 2 == 1) for i in range(200, 300) if i % 4 < 2) >= 46
    assert np.mean([got[i] for i in range(301, 320, 2)]) > np.mean([got[i] for i in range(300, 320, 2)]) + 0.3


def test_words_of_unspaced_scripts_and_long_tokens_are_cut_alike():
    def cut(*texts):
        raw = [t.encode() for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        starts, ends, first = toxicity.read_words(data, np.r_[0, np.cumsum([len(r) for r in raw])])
        return [[data[a:b].tobytes().decode() for a, b in zip(starts[x:y], ends[x:y])] for x, y in zip(first[:-1], first[1:])]

    assert cut("日本語、abc。ไทย", "", "naïve “quoted” words", "x漢y") == [[*"日本語", "abc", *"ไทย"], [], ["naïve", "quoted", "words"], ["x", "漢", "y"]]
    long = "".join(chr(97 + k % 23) for k in range(100))
    pieces = cut(long)[0]
    assert {long[k : k + 4] for k in range(97)} <= {p[k : k + 4] for p in pieces for k in range(len(p) - 3)}
    assert max(map(len, pieces)) <= 19


# quality


def test_quality_shrinks_sparse_groups(spark, odd, none):
    rows = [(i, words(50, i) if i % 4 else "| & | & " * 20) for i in range(100, 300)]
    docs = odd.union(awkward(spark, rows)).withColumn("source", F.when(F.col("doc_id") > 290, None).otherwise(F.concat(F.lit("h"), (F.col("doc_id") % 5).cast("string"))))
    labels = marks(spark, [(i, int(i % 4 > 0)) for i, _ in rows[:150]] + [(None, 1)], "quality")
    got = quality.judge(docs, labels, "source", "lang").collect()
    assert len(got) == 211
    assert all(r.keep == (r.doc_id % 4 > 0) for r in got if r.doc_id and 250 <= r.doc_id)
    assert all(0 < r.path_rate < 1 and 0 < r.host_rate < 1 for r in got)
    assert quality.judge(none, labels, "source", "lang").collect() == []
    assert {r.evidence for r in quality.judge(docs, labels.limit(0), "source", "lang").collect()} == {0.0}


# language model


def test_katz_probabilities_sum_to_one(spark):
    g = random.Random(4)
    vocabulary = ["a", "b", "c", "d", "e"]
    train = spark.createDataFrame([(" ".join(g.choice(vocabulary) for _ in range(g.randint(0, 30))),) for _ in range(60)], "text string")
    model = katz.fit(train)
    table = {r.k: r for r in model.table.collect()}
    import math

    from tablelens.llm.common import span_hashes

    def number(w):
        data = np.frombuffer(w.encode(), np.uint8)
        return span_hashes(data, np.array([0]), np.array([len(data)]))[0]

    tokens = [katz.END, *map(number, vocabulary)]
    signed = lambda h: int(np.uint64(h).astype(np.int64))
    words_only = {signed(t): table[signed(t)].score for t in tokens}
    for u in tokens:
        # score of a word holds its own backoff weight as a context; the context's weight cancels out
        total = 0.0
        docs = []
        for w in tokens:
            pair = signed(katz.pair_key(np.array([u]), np.array([w]))[0])
            docs.append((w, table[pair].score if pair in table else 0.0))
        own = {w: weight(table, model, tokens, w) for w in tokens}
        for w, gain in docs:
            total += 10 ** (words_only[signed(w)] - own[w] + own[u] + gain)
        total += 10 ** (model.unknown + own[u])
        assert math.isclose(total, 1, rel_tol=1e-9)


def weight(table, model, tokens, u):
    """log10 of a context's backoff weight, from the mass that its stored pairs leave."""
    import math

    signed = lambda h: int(np.uint64(h).astype(np.int64))
    stored = [(w, table[k].score) for w in tokens if (k := signed(katz.pair_key(np.array([u]), np.array([w]))[0])) in table]
    if not stored:
        return 0.0
    return _WEIGHTS.setdefault((id(model), int(u)), _solve(table, model, tokens, u, stored, signed, math))


_WEIGHTS: dict = {}


def _solve(table, model, tokens, u, stored, signed, math):
    # p(w) = 10 ** (score - a(w)); all a are found together by iteration from the definition
    n = model.n
    rows = {int(t): table[signed(t)] for t in tokens}
    counts = {t: round(10 ** r.base * (n + model.v + 1)) - 1 for t, r in rows.items()}
    sizes = [0] * (katz.CUTOFF + 2)
    for c in counts.values():
        if c < len(sizes):
            sizes[c] += 1
    d = katz.discounts(sizes)
    mass = sum(d[c] * c if c <= katz.CUTOFF else c for c in counts.values()) / n
    scale = min(1.0, (n / (n + 1)) / mass)
    c = counts[int(u)]
    p = (d[c] * c if c <= katz.CUTOFF else c) * scale / n
    return rows[int(u)].score - math.log10(p)


def test_language_model_stores_pairs_seen_once(spark):
    # held out is the one text whose pair of known words was seen once in training
    import zlib

    trained = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 != 2]
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    g = random.Random(12)
    rows = [(i, " ".join(g.choice("abcdefgh") for _ in range(20))) for i in trained[2:]]
    rows += [(trained[0], "once upon"), (trained[1], "a once b upon c"), (held[0], "once upon"), (held[1], "upon once")]
    got = {r.doc_id: r for r in katz.language_model_scores(awkward(spark, rows)).collect()}
    assert got[held[0]].held_out and got[held[1]].held_out and got[held[0]].base_score == pytest.approx(got[held[1]].base_score)
    train = spark.createDataFrame([(t,) for i, t in rows if i not in held], "text string")
    pairs = {p for i, t in rows if i not in held for w in [["", *t.split(), ""]] for p in zip(w, w[1:])}
    assert katz.fit(train).table.where("known = 0").count() == len(pairs)
    assert got[held[0]].score > got[held[1]].score + 0.5


def test_language_model_counts_and_rows(spark, odd, none):
    out = {r.doc_id: r for r in katz.language_model_scores(odd).collect() if r.doc_id}
    assert katz.language_model_scores(odd).count() == 11
    assert out[1].n_tokens == 1 and out[7].n_tokens == 30_001 and out[5].n_tokens == 61
    assert all(r.score <= 0 and r.base_score <= 0 and r.n_known <= r.n_tokens for r in out.values())
    assert katz.language_model_scores(none).collect() == []


def katz_by_word(texts, trained, least):
    """log10 probability of each text, token by token, from the definition in katz.py."""
    import math
    from collections import Counter

    rows = [[*t.lower().split(), ""] for t in texts]
    learned = [r for r, keep in zip(rows, trained) if keep]
    c, pairs = Counter(w for r in learned for w in r), Counter(p for r in learned for p in zip(["", *r], r))
    n = sum(c.values())

    def discounted(counts):
        sizes = Counter(counts.values())
        d = katz.discounts([0] + [sizes[r] for r in range(1, katz.CUTOFF + 2)])
        return {k: d[x] * x if x <= katz.CUTOFF else x for k, x in counts.items()}

    dw, dp = discounted(c), discounted(pairs)
    mass = sum(dw.values()) / n
    scale = min(1, n / (n + 1) / mass)
    p = {w: x * scale / n for w, x in dw.items()}
    f, a = {}, {}
    for u in c:
        stored = [w for v, w in pairs if v == u and pairs[v, w] >= least]
        share, most = sum(dp[u, w] for w in stored) / c[u], c[u] / (c[u] + 1)
        f[u] = most / share if share > most else 1.0
        a[u] = (1 - f[u] * share) / max(1 - sum(p[w] for w in stored), 1e-300)
    one = lambda u, w: f[u] * dp[u, w] / c[u] if pairs[u, w] >= least else a.get(u, 1) * p.get(w, 1 - mass * scale)
    return [sum(math.log10(one(u, w)) for u, w in zip(["", *r], r)) for r in rows]


@pytest.mark.parametrize(("least", "frequent", "part"), [(1, 1 << 19, 1 << 20), (1, 3, 100), (2, 6, 100)])
def test_language_model_equals_katz_word_by_word(spark, monkeypatch, least, frequent, part):
    monkeypatch.setattr(katz, "FREQUENT", frequent)
    monkeypatch.setattr(katz, "PART", part, raising=False)
    g = random.Random(21)
    words_ = [f"W{i}" for i in range(40)]
    texts = [" ".join(words_[min(int(g.paretovariate(0.7)) - 1, 39)] for _ in range(g.randint(0, 25))) for _ in range(120)] + ["", "new words here", "w0 W0 w0 new w0"]
    rows = list(enumerate(texts)) + [(5, texts[5])]
    import zlib

    trained = [zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows]
    assert not all(trained)
    want = sorted((i, s) for (i, _), s in zip(rows, katz_by_word([t for _, t in rows], trained, least)))
    got = sorted((r.doc_id, r.score) for r in katz.language_model_scores(awkward(spark, rows), least=least).collect())
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want], rel=1e-9)


def test_language_model_without_training_texts(spark):
    import zlib

    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    got = katz.language_model_scores(awkward(spark, [(i, "some words") for i in held])).collect()
    assert len(got) == len(held) and all((r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 3, 0, 0, 0, 0) for r in got)


def test_language_model_writes_no_table_of_pairs(spark):
    # every pair is new: tables of pairs would hold all of them, and fill the disk
    import os

    from tablelens.session import scratch_base

    g = random.Random(22)
    texts = [[f"w{int(g.random() * 1000)}" for _ in range(400)] for _ in range(200)]
    pairs = {p for t in texts for p in zip(t, t[1:])}
    at = os.path.join(scratch_base(spark).removeprefix("file://"), "tablelens")
    before = set(os.listdir(at)) if os.path.isdir(at) else set()
    assert katz.language_model_scores(awkward(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])).count() == 200
    stored = sum(spark.read.parquet(os.path.join(at, x)).count() for x in set(os.listdir(at)) - before)
    assert 0 < stored < len(pairs) / 2


# search


def test_threshold_search_equals_brute_force(spark):
    g = random.Random(8)
    rows = [(i, [g.choice([-0.25, 0.0, 0.125, 0.5, g.uniform(-1, 1)]) for _ in range(8)]) for i in range(300)]
    odd_rows = [(300, None), (301, [None] * 8), (302, [float("nan")] + [0.0] * 7), (303, [float("inf")] * 8), (304, [0.0] * 8), (305, [1.0]), (None, [1.0] * 8)]
    vectors = spark.createDataFrame(rows + odd_rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = [tuple(r) for r in topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), 7).collect()]
    v = {i: [int(np.floor(64 * x)) for x in e] + [0] * (8 - len(e)) for i, e in rows + [odd_rows[4], odd_rows[5]]}
    want = []
    for q in v:
        if q % 20 == 0:
            best = sorted(((-sum(a * b for a, b in zip(v[q], v[i])), i) for i in v if i != q))[:7]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert sorted(got) == sorted(want)
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).collect() == []


def _brute_top(ids, v, qs, own, k):
    out = []
    for i, q in enumerate(qs):
        scores = v.astype(object) @ q.astype(object)
        rows = [r for r in np.lexsort((ids, [-int(x) for x in scores])) if ids[r] != own[i]][:k]
        out += [(i, r, int(scores[r])) for r in rows]
    return out


@pytest.mark.parametrize("decay, share", [(0.6, 0.2), (1.0, 1.0)])
def test_search_stops_early_without_loss(decay, share):
    """On decaying axes, in any rotation, few vectors are scored; without structure all may be."""
    g = np.random.default_rng(2)
    turn, _ = np.linalg.qr(g.standard_normal((32, 32)))
    v = np.floor(64 * (g.standard_normal((20000, 32)) * decay ** np.arange(32)) @ turn)
    ids = g.permutation(20000)
    for kind in (np.float64, np.int64):
        lists = topk.Lists(ids, v.astype(kind))
        qs, own = v[::1000].astype(kind), ids[::1000]
        which, rows, scores, taken = lists.top(qs, own, 5)
        assert list(zip(which, rows, scores)) == _brute_top(ids, v.astype(np.int64), qs.astype(np.int64), own, 5)
        assert taken <= share * len(qs) * len(v)


def test_search_in_several_blocks(spark, monkeypatch):
    """Ties, repeated ids and few values, in many small blocks."""
    monkeypatch.setattr(topk, "NUMBERS", 256)
    monkeypatch.setattr(topk, "AHEAD", 16)
    g = np.random.default_rng(4)
    ids = np.concatenate([np.arange(300), np.full(80, 20)])
    v = g.integers(-2, 3, (380, 4))
    rows = [(int(i), [float(x) / 64 for x in e]) for i, e in zip(ids, v)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 6).collect())
    asked = np.flatnonzero(ids % 50 == 0)
    want = _brute_top(ids, v, v[asked], ids[asked], 6)
    assert sorted((q, i, s) for q, _, i, s in got) == sorted((int(ids[asked[i]]), int(ids[r]), s) for i, r, s in want)


# repeated passages


def brute_repeats(rows, window):
    first = {}
    split = [(i if i is not None else 2**63 - 1, (t or "").split()) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone)))
    return sorted(out)


def test_repeats_equal_brute_force(spark, odd, none):
    g = random.Random(6)
    shared = [words(g.randint(10, 40), 900 + k) for k in range(6)]
    rows = [(100 + i, " ".join(g.choice(shared) if g.random() < 0.4 else words(g.randint(1, 30), 5000 + 10 * i + k) for k in range(6))) for i in range(60)]
    rows += [(160, shared[0]), (161, shared[0]), (161, shared[0]), (162, " a b" * 40), (163, "a b " * 50)]
    docs = odd.union(awkward(spark, rows))
    every = [(r.doc_id, r.text) for r in docs.collect()]
    got = debruijn.without_repeats(docs).collect()
    assert sorted((2**63 - 1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed) for r in got) == brute_repeats(every, 13)
    texts = {i: (t or "").split() for i, t in every if i is not None}
    for s in debruijn.repeated_spans(docs).where("doc_id is not null").collect():
        assert texts[s.doc_id][s.start : s.start + s.length] == texts[s.source_id][s.source_start : s.source_start + s.length]
    assert debruijn.without_repeats(none).collect() == []


def test_reading_without_gradients_equals_the_forward_pass():
    rng = np.random.default_rng(4)
    net = toxicity.Network(10)
    x = rng.standard_normal((50, toxicity.DIM)).astype(np.float32)
    x[-1] = 0
    room = {}
    for n, shortest in ((7, 0), (7, toxicity.LENGTH), (3, 1)):
        lengths = rng.integers(shortest, toxicity.LENGTH + 1, n)
        within = np.arange(toxicity.LENGTH) < lengths[:, None]
        place = np.where(within, rng.integers(0, 49, (n, toxicity.LENGTH)), 49)
        want = net.forward(x[place], within.astype(np.float32))[0]
        assert np.allclose(net.logits(x, place.T, lengths, room), want, atol=1e-5)


def test_scores_do_not_depend_on_slices(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = [f"word{i}" for i in range(300)] + ["漢字", "é"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 400))) for _ in range(30)] + [None, "", "x" * 3000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    whole = toxicity.toxicity(docs, model).orderBy("doc_id").collect()

    def scores(size):  # as a worker would with that slice size
        import pyarrow as pa

        monkeypatch.setattr(toxicity, "SLICE", size)
        return np.concatenate([model.scores(d, *toxicity.read_words(d, o)) for _, _, d, o in toxicity.text_slices(pa.array(texts))])

    assert np.allclose([r.score for r in whole], scores(100), atol=1e-6)
    assert np.allclose([r.score for r in whole], scores(1 << 30), atol=1e-6)


def test_repeated_training_ids_give_one_model(spark):
    docs = spark.createDataFrame([(1, "b text"), (1, "a text"), (2, "fine"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    found = [sorted(map(tuple, toxicity.sample(docs.repartition(n), labels, 5, 2, 4, "doc_id", "text").collect())) for n in (1, 3, 4)]
    assert found[0] == found[1] == found[2] and [(r[0], r[1]) for r in found[0]] == [(1, 1), (2, 0)]
