import json

import pytest
from pyspark.sql import functions as F

from tablelens.operators import prompts as L


def test_preview(spark):
    df = spark.createDataFrame([(i, f"n{i}" if i else None) for i in range(150)], "id long, name string").repartition(4)
    text = L.table_preview(df, ["id"]).first().content
    assert text.split("\n")[:3] == ["id\tname", "0\tnull", "1\tn1"] and text.count("\n") == 101
    wide = spark.createDataFrame([("x" * 60_000,)], "t string")
    assert len(L.table_preview(wide, ["t"]).first().content) == 50_000
    assert len(L.text_context(wide.select(F.lit(1).alias("id"), "t"), ["id"], "t").first().content) == 50_000


def test_cuts_are_arguments_and_are_told(spark):
    df = spark.createDataFrame([(1, "中" * 10), (2, "ab"), (3, None), (4, "")], "id long, t string")
    shown = lambda x: [(r.content, r.cut) for r in x.orderBy("id").collect()]
    assert shown(L.text_context(df, ["id"], "t", limit=4)) == [("中" * 4, True), ("ab", False), (None, False), ("", False)]
    assert shown(L.text_context(df, ["id"], "t", limit=None))[0] == ("中" * 10, False)
    assert shown(L.overview_prompts(df, ["id"], "t", limit=10))[0] == ("中" * 10, False)
    assert shown(L.paragraph_prompts(df, ["id"], "t", limit=1)) == [("中", True), ("a", True)]
    named = df.where("id < 3").select("t")
    preview = L.table_preview(named, ["t"], limit=3).first()
    assert (preview.content, preview.cut) == ("t\na", True)
    assert not L.table_preview(named, ["t"], limit=None).first().cut


def test_paragraph_prompts(spark):
    long = "世" * 1500 + "x" * 1000
    df = spark.createDataFrame([(1, f"  a line \n second\t\n\n{long}\n\n{'y' * 1990}")], "id int, text string")
    got = L.paragraph_prompts(df, ["id"], language="English").orderBy("paragraph_no").collect()
    assert [r.paragraph_no for r in got] == [1, 2, 3]
    assert got[0].content == "a line second" and got[1].content == long[:2000] and len(got[2].content) == 1990
    assert [m.role for m in got[0].messages] == ["system", "user"]
    assert got[0].messages[0].content.endswith("请用English输出。") and got[0].messages[1].content == "a line second"
    over = L.overview_prompts(df, ["id"]).first()
    assert len(over.content) == 3000 and over.messages[1].content == over.content


def test_history_drops_unanswered_questions(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", " q1 "), (1, 2, "assistant", "a1"), (1, 3, "user", "q2"),
            (1, 4, "assistant", "  "), (1, 5, "user", "q3"), (2, 0, "user", ""), (2, 1, "assistant", "a")]
    got = L.conversation_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted(map(tuple, got.collect())) == [(1, 0, "system", "s"), (1, 1, "user", "q1"), (1, 2, "assistant", "a1")]


def test_request_parts_join_to_json(spark):
    turns = [(1, t, "user" if t % 2 == 0 else "assistant", f'say "{t}"\n') for t in range(301)] + [(2, 0, "user", "a"), (2, 1, "assistant", "b")]
    history = spark.createDataFrame(turns, "conv_id long, turn long, role string, content string").repartition(5)
    parts = L.conversation_requests(history, "m", 'be "brief"', thinking=True, effort="max").orderBy("conv_id", "part").collect()
    bodies = {c: json.loads("".join(p.body for p in parts if p.conv_id == c)) for c in (1, 2)}
    assert [m["content"] for m in bodies[1]["messages"][1:]] == [x for _, _, _, x in turns[:301]]
    assert bodies[2] == {
        "model": "m", "stream": False, "temperature": 0.3, "max_tokens": 2000,
        "thinking": {"type": "enabled"}, "reasoning_effort": "max",
        "messages": [{"role": "system", "content": 'be "brief"'}, {"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}],
    }


def body(spark, **kw):
    df = spark.createDataFrame([("hi",)], "u string")
    out = df.select(L.request_body("m", L.exchange(F.lit("s"), F.col("u")), **kw).alias("b")).first().b
    return json.loads(out)


def test_request_bodies(spark):
    plain = body(spark, temperature=None)
    assert plain == {
        "model": "m", "stream": False, "thinking": {"type": "disabled"},
        "messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "hi"}],
    }
    on = body(spark, thinking=True, effort="xhigh", stream=True, max_tokens=5, top_p=0.5)
    assert (on["thinking"], on["reasoning_effort"], on["stream"], on["max_tokens"], on["top_p"]) == ({"type": "enabled"}, "max", True, 5, 0.5)
    assert body(spark, thinking=True)["reasoning_effort"] == "high"
    assert "reasoning_effort" not in body(spark, thinking=False)


@pytest.mark.parametrize(
    "kw, want",
    [
        ({}, {"effort": "high", "exclude": False}),
        ({"thinking": False}, {"effort": "none", "exclude": False}),
        ({"thinking": True}, {"effort": "high", "exclude": False}),
        ({"thinking": True, "effort": "low", "exclude": True}, {"effort": "low", "exclude": True}),
        ({"thinking": True, "effort": "low", "thinking_tokens": 99}, {"max_tokens": 99, "exclude": False}),
    ],
)
def test_reasoning_dialect(spark, kw, want):
    assert body(spark, dialect="reasoning", **kw)["reasoning"] == want


def test_unknown_dialect(spark):
    with pytest.raises(ValueError):
        body(spark, dialect="other")


def test_effort(spark):
    df = spark.createDataFrame([(e,) for e in ("low", "medium", "high", "xhigh", "max", "odd")], "e string")
    assert [r.x for r in df.select(L.effort_level(F.col("e")).alias("x")).collect()] == ["high"] * 3 + ["max"] * 2 + [None]


def test_attached_files(spark):
    messages = spark.createDataFrame([("r1", 0, "user", "q"), ("r2", 0, "user", "z")], "request_id string, position long, role string, content string")
    files = spark.createDataFrame([("r1", 0, "a.txt", "A"), ("r1", 1, "b.txt", "B")], "request_id string, ord long, path string, content string")
    got = L.attach_files(messages, files).orderBy("request_id", "position", "part").collect()
    first = "".join(r.content for r in got if r.position == -1)
    assert first == L.FILES_PROMPT + "[文件: a.txt]\n```\nA\n```\n\n[文件: b.txt]\n```\nB\n```"
    assert [(r.request_id, r.role) for r in got if r.position == 0] == [("r1", "user"), ("r2", "user")]


def test_responses(spark):
    rows = [
        ('{"choices":[{"message":{"content":"hi"}}],"model":"m","usage":{"prompt_tokens":1,"completion_tokens":2,"total_tokens":3}}', "hi", "m", 1, False),
        ('{"choices":[{"message":{"content":""}}]}', "", "unknown", None, True),
        ('{"choices":[],"usage":{}}', "", "unknown", 0, True),
        ("{}", "", "unknown", None, True),
        ("oops", "", "unknown", None, True),
    ]
    df = spark.createDataFrame([(r[0],) for r in rows], "body string")
    got = L.parse_responses(df).collect()
    assert [(r.body, r.content, r.model, r.prompt_tokens, r.is_error) for r in got] == rows
    lenient = L.parse_responses(df, empty_is_error=False).collect()
    assert [r.is_error for r in lenient] == [False, False, False, False, True]


def test_chunks(spark):
    payload = (
        ': ping\n\ndata: {"choices":[{"delta":{"content":"He"}}]}\r\n'
        '  data: {"choices":[{"delta":{"content":"llo"}}]}  \ndata: {"choices":[]}\ndata: {"choices":[{"delta":{}}]}\n'
        "data: broken\nevent: x\ndata:{}\ndata: [DONE]\n"
    )
    got = L.parse_chunks(spark.createDataFrame([(1, payload)], "id int, payload string"), ["id"]).orderBy("line_no").collect()
    assert [(r.content, r.done) for r in got] == [("He", False), ("llo", False), ("", True)]


def test_cleanup(spark):
    df = spark.createDataFrame([(" a\n",), (" \t",), (None,)], "content string")
    assert [tuple(r) for r in L.clean_replies(df).collect()] == [("a", False), ("", True), (None, True)]


def test_the_open_question_is_asked(spark):
    rows = [(1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (1, 2, "user", " q2 "), (2, 0, "user", "only"), (3, 0, "user", "x"), (3, 1, "user", " ")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    history = L.conversation_messages(turns, pending=True)
    assert sorted((r.conv_id, r.content) for r in history.collect()) == [(1, "a1"), (1, "q1"), (1, "q2"), (2, "only")]
    files = [(1, 0, "a.txt", 'say "hi"\n\\'), (1, 1, "b.txt", None), (1, 2, "c.txt", "漢"), (9, 0, "z", "no such conversation")]
    files = spark.createDataFrame(files, "conv_id long, ord long, path string, content string").repartition(3)
    parts = L.conversation_requests(history, "m", "s", files=files).orderBy("conv_id", "part").collect()
    bodies = {c: json.loads("".join(p.body for p in parts if p.conv_id == c)) for c in {p.conv_id for p in parts}}
    assert set(bodies) == {1, 2}
    assert [m["content"] for m in bodies[1]["messages"]][1:] == ["s", "q1", "a1", "q2"]
    attached = bodies[1]["messages"][0]
    assert attached["role"] == "system" and attached["content"].startswith(L.FILES_PROMPT + '[文件: a.txt]\n```\nsay "hi"\n\\\n```')
    assert attached["content"].endswith("[文件: c.txt]\n```\n漢\n```")
    assert [m["content"] for m in bodies[2]["messages"]] == ["s", "only"]


def test_replies_cut_anywhere(spark, monkeypatch):
    monkeypatch.setattr(L, "_SEQUENCE", 7)
    line = 'data: {"choices":[{"delta":{"content":"%s"}}]}\r\n\n'
    whole = (": ping\n" + "".join(line % w for w in ("Hé", "漢字", "😀 x", "", "end")) + "data: [DONE]\n").encode()
    uncut = L.parse_chunks(spark.createDataFrame([(1, whole.decode())], "id int, payload string"), ["id"])
    want = sorted(tuple(r)[1:] for r in uncut.collect())
    assert [w[2] for w in want] == ["Hé", "漢字", "😀 x", "end", ""]
    for size in (1, 5, 61, 10_000):
        rows = [(k, i // size, whole[i : i + size]) for k in (1, None) for i in range(0, len(whole), size)]
        got = L.parse_chunk_stream(spark.createDataFrame(rows, "id int, seq int, payload binary").repartition(3), ["id"], "seq").collect()
        assert sorted(tuple(r)[1:] for r in got if r.id == 1) == want == sorted(tuple(r)[1:] for r in got if r.id is None)
