import random

import pytest

from tablelens.operators import row_profile as RP
from tablelens.operators import text_profile as TP


def test_rows(spark):
    df = spark.createDataFrame([("row1", 10.0, 20.0), ("row2", 30.0, 40.0)], "name string, a double, b double")
    got = RP.row_profile(df, name_column="name", name_in_values=False).collect()
    assert [(r.name, r.is_numeric, r["count"], r.mean, r.median) for r in got] == [("row1", True, 2, 15.0, 15.0), ("row2", True, 2, 35.0, 35.0)]
    assert got[0].std_dev == 5.0 and got[0].skewness == 0.0 and got[0].kurtosis == -2.0
    mixed = RP.row_profile(df, name_column="name").first()
    assert mixed.dtype == "str" and mixed.mean is None and mixed["count"] == 3
    numbered = RP.row_profile(df, columns="1:2", order_by=["name"]).collect()
    assert [r.name for r in numbered] == ["0", "1"]


def test_odd_cells(spark):
    df = spark.createDataFrame([("k", 0.0, "5", "x"), ("l", float("inf"), "nan", "x"), ("m", None, "1", "")], "id string, a double, b string, c string")
    got = {r.name: r for r in RP.row_profile(df, columns="0:2", name_column="id", name_in_values=False).collect()}
    assert got["k"].is_numeric and got["k"].zero_count == 1 and got["k"].non_zero_valid_count == 1 and got["k"].mean == 2.5
    assert got["l"].is_numeric and got["l"].mean is None and got["l"].min is None
    assert not got["m"].is_numeric
    tops = {r.name: r.top_freq_content for r in RP.row_profile(df, columns="2:3", name_column="id").collect()}
    assert tops["k"] == ("5", 1) and tops["m"] == ("1", 1)


def test_row_fields(spark):
    df = spark.createDataFrame([(f"k{i:02}", "two words", None) for i in range(30)], "a string, b string, c string")
    got = RP.row_fields(df, 20, ["a"]).collect()
    assert len(got) == 20 and tuple(got[0]) == (0, 3, 3)


def test_text_profile(spark):
    text = "Hello world this is a test file.\nIt has multiple lines.\n中文字符也支持。\n"
    got = TP.text_profile(spark.createDataFrame([(1, text)], "id int, text string"), ["id"], width=80).first()
    assert (got.en_words, got.cn_chars, got.total, got.soft_lines, got.paragraphs) == (11, 7, 18, 3, 1)
    s = TP.text_summary(spark.createDataFrame([(1, "don't stop")], "id int, text string"), ["id"]).first()
    assert (s.en_words, s.en_words_no_punct) == (3, 2)


def test_paragraph_table(spark):
    df = spark.createDataFrame([(1, "A\n\n\nB\n\n \n\nC")], "id int, text string")
    assert [(r.paragraph_no, r.paragraph) for r in TP.split_paragraphs(df, ["id"]).collect()] == [(1, "A"), (2, "\nB"), (3, "C")]


@pytest.mark.parametrize("chunk", [1, 2, 3, 100])
def test_line_profile_equals_whole_profile(spark, chunk):
    """Random blank and empty lines, with chunk edges in every place."""
    rng = random.Random(11)
    docs = []
    for i in range(120):
        parts = [rng.choice(["", "", "", " ", "\t", "one two", "中文 words here", "x"]) for _ in range(rng.randint(1, 12))]
        docs.append((i, parts))
    whole = spark.createDataFrame([(i, "\n".join(p)) for i, p in docs], "file int, text string")
    lines = spark.createDataFrame([(i, n, x) for i, p in docs for n, x in enumerate(p)], "file int, line_no long, line string")
    fields = ["file", "en_words", "cn_chars", "soft_lines", "paragraphs", "total"]
    a = TP.text_profile(whole, ["file"], width=8).select(fields)
    b = TP.text_profile_of_lines(lines, "file", 8, chunk).select(fields)
    want, got = sorted(map(tuple, a.collect())), sorted(map(tuple, b.collect()))
    assert [(w, docs[w[0]]) for w, g in zip(want, got) if w != g] == []
    assert len(want) == len(got)


def test_wrapped_table(spark):
    df = spark.createDataFrame([(1, "Hello world this is a test")], "id int, line string")
    assert [(r.part, r.line) for r in TP.wrapped(df, ["id"], width=20).collect()] == [(0, "Hello world this is"), (1, "a test")]
