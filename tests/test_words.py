import random

import pytest
from pyspark.sql import functions as F

from tablelens.functions import words as W


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("r")).first().r


def char_width(ch):
    import unicodedata

    if unicodedata.category(ch) in ("Mn", "Me", "Cc"):
        return 0
    return 2 if unicodedata.east_asian_width(ch) in ("W", "F") else 1


def width_of(text):
    return sum(map(char_width, text))


def greedy(text, width):
    """Word wrap, the plain way."""
    lines, cur = [], None
    for word in text.split():
        if cur is None:
            cur = word
        elif width_of(cur) + 1 + width_of(word) <= width:
            cur += " " + word
        else:
            lines.append(cur)
            cur = word
    return lines + ([] if cur is None else [cur])


def py_lines(text):
    parts = text.split("\n")
    if parts and parts[-1] == "":
        parts.pop()
    return [p.removesuffix("\r") for p in parts]


def soft(text, width):
    total = 0
    for para in text.split("\n\n"):
        for i, line in enumerate(py_lines(para) if para else []):
            if line.strip():
                total += len(greedy(line, width))
            elif i > 0:
                total += 1
    return total


@pytest.mark.parametrize(
    "text, en, cn",
    [
        ("Hello world! This is a test. How are you?", 9, 0),
        ("你好世界！这是一个测试。", 0, 10),
        ("Hello 世界！This is 测试。", 3, 4),
        ("Hello 世界！", 1, 2),
        ("", 0, 0),
        (" ,.; ", 0, 0),
        ("don't", 2, 0),
        ("éa1", 1, 0),
        ("a", 1, 0),
    ],
)
def test_word_counts(spark, text, en, cn):
    got = one(spark, text, W.word_count)
    assert (got.en_words, got.cn_chars, got.total) == (en, cn, en + cn)


def test_null_text_has_no_count(spark):
    assert one(spark, None, W.en_words) is None


def test_punctuation(spark):
    assert one(spark, "Hello, world! How are you?", W.clean_punct) == "Hello world How are you"
    assert one(spark, "don't stop", W.total_words) == 3
    assert one(spark, "don't stop", W.total_words_no_punct) == 2


@pytest.mark.parametrize(
    "text, cells",
    [("abc", 3), ("世界", 4), ("é", 1), ("a​b", 2), ("Ａ", 2), ("한글", 4), ("", 0), ("naïve – “q”", 11), ("😀", 2)],
)
def test_display_width(spark, text, cells):
    assert one(spark, text, W.display_width) == cells


def test_wrap_examples(spark):
    assert one(spark, "Hello world this is a test", lambda c: W.wrap_words(c, 20)) == "Hello world this is\na test"
    assert one(spark, "short line", lambda c: W.wrap_words(c, 80)) == "short line"
    assert one(spark, "any  text ", lambda c: W.wrap_words(c, 0)) == "any  text "
    assert one(spark, "", lambda c: W.wrap_words(c, 20)) == ""
    wrapped = one(spark, "    Hello world this is a longer test message", lambda c: W.wrap_words(c, 20))
    assert len(wrapped.split("\n")) > 1 and all(line.startswith("    H"[:4]) for line in wrapped.split("\n"))
    assert one(spark, "a incomprehensibilities b", lambda c: W.wrap_words(c, 10)) == "a\nincomprehensibilities\nb"


def random_texts(seed, alphabet, n=150):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]


ALPHABETS = ["ab \t", "abcdefé    \n", "a世 界b \n\n ", "ab \n\n\n\r", "xý 世​ \n"]


@pytest.mark.parametrize("alphabet", ALPHABETS)
@pytest.mark.parametrize("width", [1, 7, 12])
def test_wrap_against_brute_force(spark, alphabet, width):
    texts = [t.replace("\n", " ").replace("\r", " ") for t in random_texts(1, alphabet)]
    texts = [t.strip() for t in texts if "​" not in t]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: list(r.w) for r in df.select("i", W.wrap_lines(F.col("t"), width).alias("w")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == greedy(t, width), repr(t)


@pytest.mark.parametrize("alphabet", ALPHABETS[:4])
@pytest.mark.parametrize("width", [5, 20])
def test_soft_lines_against_brute_force(spark, alphabet, width):
    texts = random_texts(2, alphabet)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.n for r in df.select("i", W.soft_lines(F.col("t"), width).alias("n")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == soft(t, width), repr(t)


def test_both_wrap_paths_agree(spark):
    texts = random_texts(3, "abc  d")
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    same = F.col("t")
    rows = df.select(W.wrap_lines(same, 9).alias("a"), W._fold_words(same, 9).alias("b"), W.strip_leading(same).alias("s"), same)
    for r in rows.collect():
        assert [x.strip() for x in r.a] == r.b


def test_soft_line_example(spark):
    text = "Hello world this is a longer text\nAnother line here"
    assert one(spark, text, lambda c: W.soft_lines(c, 20)) == 3
    assert one(spark, "", lambda c: W.soft_lines(c, 20)) == 0
    assert one(spark, "a\nb\n\nc", lambda c: W.soft_lines(c, 0)) == 3


def test_wrap_chars(spark):
    assert one(spark, "abcdefgh", lambda c: W.wrap_chars(c, 3)) == "abc\ndef\ngh"
    assert one(spark, "  abcdef", lambda c: W.wrap_chars(c, 3)) == "  abc\n  def"
    assert one(spark, "  abcdef", lambda c: W.wrap_chars(c, 3, True)) == "  abcde\n  f"
    assert one(spark, "世界和平", lambda c: W.wrap_chars(c, 5)) == "世界\n和平"
    assert one(spark, "   ", lambda c: W.wrap_chars(c, 5)) == ""
    assert one(spark, "ab", lambda c: W.wrap_chars(c, 0)) == "ab"


@pytest.mark.parametrize(
    "text, n",
    [
        ("Paragraph one.\nStill paragraph one.\n\nParagraph two.\n\nParagraph three.", 3),
        ("A\n\n\nB", 2),
        ("", 0),
        ("one", 1),
        ("中文。\n\n　\n\n第二段", 2),
    ],
)
def test_paragraphs(spark, text, n):
    assert one(spark, text, W.paragraph_count) == n
