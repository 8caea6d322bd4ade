"""Messages for a language model: request tables out of texts, reply tables back in.

No model is called here. Requests leave as rows with a JSON body, replies come back as
rows with a JSON body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablelens.functions.columns import quoted, render_tsv, tsv_header
from tablelens.functions.words import strip_space
from tablelens.operators.positions import head
from tablelens.operators.text_profile import split_paragraphs

PREVIEW_ROWS = 100
# Where texts are cut unless another limit, or None, is asked for; the column `cut` says which were.
CONTEXT_CHARS = 50_000
PARAGRAPH_LIMIT = 2_000
OVERVIEW_CHARS = 3_000
TURNS_PER_PART = 64

# Instruction texts.
ANSWER_PROMPT = "你是一个数据分析助手。请基于以下文件内容回答用户的问题。请用{language}回答。\n\n文件内容:\n"
PARAGRAPH_PROMPT = (
    "请用不超过30个词/字（不含标点）总结以下段落的大意。\n"
    "仅输出最终总结，不要包含任何思考过程、自我反思、元评论或格式说明。\n"
    "请用{language}输出。"
)
OVERVIEW_PROMPT = (
    "请对以下文字进行全面概述。要求：\n"
    "1. 长度至少 100 个英文单词或 300 个中文字符（不含标点）。\n"
    "2. 表达简洁精炼，避免冗余，突出重点信息。\n"
    "3. 仅输出最终概述正文，不要包含任何思考过程、自我反思、元评论或格式说明。\n"
    "4. 请用{language}输出。"
)
FILES_PROMPT = "以下是用户上传的文件内容，请参考这些内容回答用户问题：\n\n"
FILE_BLOCK = "[文件: {path}]\n```\n{content}\n```"

TEMPERATURE = 0.3
ANSWER_TOKENS, PARAGRAPH_TOKENS, OVERVIEW_TOKENS = 2000, 500, 1500
EFFORTS = {"low": "high", "medium": "high", "high": "high", "xhigh": "max", "max": "max"}


# --- contexts ------------------------------------------------------------


def _limited(text: Column, limit: int | None) -> list[Column]:
    """content, cut: a text's first `limit` characters, all for None, and whether there were more."""
    if limit is None:
        return [text.alias("content"), F.lit(False).alias("cut")]
    more = F.coalesce(F.char_length(text) > limit, F.lit(False))
    return [F.substring(text, 1, limit).alias("content"), more.alias("cut")]


def table_preview(
    df: DataFrame, order_by: list[str] | None = None, rows: int = PREVIEW_ROWS, limit: int | None = CONTEXT_CHARS
) -> DataFrame:
    """(content, cut): header and first rows as tab-separated lines, cut to `limit` characters."""
    first = head(df, rows, order_by)
    if order_by:  # the list is sorted by key after the limit has bounded it
        keyed = first.select(F.struct(*[quoted(k) for k in order_by], render_tsv(first)).alias("r"))
        lines = F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"])
    else:
        keyed = first.select(render_tsv(first).alias("r"))
        lines = F.collect_list("r")
    text = F.concat(
        F.lit(tsv_header(df) + "\n"), F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    )
    return keyed.agg(text.alias("text")).select(*_limited(F.col("text"), limit))


def text_context(docs: DataFrame, keys: list[str], text: str = "text", limit: int | None = CONTEXT_CHARS) -> DataFrame:
    """(keys, content, cut): every text cut to `limit` characters."""
    return docs.select(*keys, *_limited(quoted(text), limit))


# --- messages ------------------------------------------------------------


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def exchange(system: Column, user: Column) -> Column:
    """The two-message array of a single question."""
    return F.array(message("system", system), message("user", user))


def answer_messages(content: Column, question: Column, language: str = "中文") -> Column:
    prompt = F.concat(F.lit(ANSWER_PROMPT.format(language=language)), content)
    return exchange(prompt, question)


def paragraph_prompts(
    docs: DataFrame, keys: list[str], text: str = "text", language: str = "中文", limit: int | None = PARAGRAPH_LIMIT
) -> DataFrame:
    """(keys, paragraph_no, content, cut, messages): one summary request per paragraph.

    Lines are trimmed and joined by a blank. Of a paragraph its first `limit` characters are kept.
    """
    lines = F.split(F.regexp_replace("paragraph", r"\r?\n\z", ""), r"\r?\n")
    joined = F.array_join(F.transform(lines, strip_space), " ")
    parts = split_paragraphs(docs, keys, text).select(*keys, "paragraph_no", joined.alias("p"))
    parts = parts.select(*keys, "paragraph_no", *_limited(F.col("p"), limit))
    system = F.lit(PARAGRAPH_PROMPT.format(language=language))
    return parts.withColumn("messages", exchange(system, F.col("content")))


def overview_prompts(
    docs: DataFrame, keys: list[str], text: str = "text", language: str = "中文", limit: int | None = OVERVIEW_CHARS
) -> DataFrame:
    """(keys, content, cut, messages): one overview request per text, from its first `limit` characters."""
    first = docs.select(*keys, *_limited(quoted(text), limit))
    system = F.lit(OVERVIEW_PROMPT.format(language=language))
    return first.withColumn("messages", exchange(system, F.col("content")))


def conversation_messages(turns: DataFrame, pending: bool = False) -> DataFrame:
    """(conv_id, turn, role, content): the history that conversations build up.

    From (conv_id, turn, role, text): system messages, and each question that got a
    non-empty answer in the next turn, with that answer. A question without one is dropped,
    but with `pending` the one that a conversation ends with stays: it is what a request asks.
    The join key (conv_id, turn) is unique, so a conversation of any length is spread out.
    """
    text = strip_space(F.col("text"))
    said = turns.select("conv_id", "turn", "role", text.alias("content"))
    asked = said.where((F.col("role") == "user") & (F.col("content") != ""))
    answers = said.where((F.col("role") == "assistant") & (F.col("content") != "")).select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("content").alias("answer")
    )
    pairs = asked.join(answers, ["conv_id", "turn"]).select(
        "conv_id",
        F.inline(
            F.array(
                F.struct(F.col("turn"), F.lit("user").alias("role"), F.col("content")),
                F.struct(
                    (F.col("turn") + 1).alias("turn"), F.lit("assistant").alias("role"), F.col("answer").alias("content")
                ),
            )
        ),
    )
    history = said.where(F.col("role") == "system").unionByName(pairs)
    if not pending:
        return history
    last = said.groupBy("conv_id").agg(F.max_by(F.struct("turn", "role", "content"), "turn").alias("last")).select("conv_id", "last.*")
    return history.unionByName(last.where((F.col("role") == "user") & (F.col("content") != "")))


def attach_files(messages: DataFrame, files: DataFrame) -> DataFrame:
    """Put attached files in front of request messages, as parts of one system message.

    messages: (request_id, position, role, content), positions from 0.
    files: (request_id, ord, path, content), ord from 0.
    Result: (request_id, position, part, role, content); a message is its parts in order.
    The files' message stands at position -1. Parts keep every file a row of its own, so
    neither a join nor a list of all files of one request is needed.
    """
    before, after = FILE_BLOCK.split("{path}")
    middle, end = after.split("{content}")
    block = F.concat(F.lit(before), F.col("path"), F.lit(middle), F.col("content"), F.lit(end))
    opening = F.when(F.col("ord") == 0, F.lit(FILES_PROMPT)).otherwise(F.lit("\n\n"))
    parts = files.select(
        "request_id",
        F.lit(-1).cast("bigint").alias("position"),
        F.col("ord").cast("bigint").alias("part"),
        F.lit("system").alias("role"),
        F.concat(opening, block).alias("content"),
    )
    given = messages.select(
        "request_id",
        F.col("position").cast("bigint").alias("position"),
        F.lit(0).cast("bigint").alias("part"),
        "role",
        "content",
    )
    return parts.unionByName(given)


# --- requests ------------------------------------------------------------


def effort_level(effort: Column) -> Column:
    """Five effort names to the two that the 'thinking' dialect knows."""
    out = F.lit(None).cast("string")
    for name, level in EFFORTS.items():
        out = F.when(effort == name, level).otherwise(out)
    return out


def _reasoning_fields(
    dialect: str, enabled: bool | None, effort: str | None, max_tokens: int | None, exclude: bool
) -> list[Column]:
    """The extra body fields; enabled=None stands for 'no setting given'."""
    if dialect == "thinking":
        state = F.struct(F.lit("enabled" if enabled else "disabled").alias("type")).alias("thinking")
        return [state, F.lit(EFFORTS[effort or "high"]).alias("reasoning_effort")] if enabled else [state]
    if dialect != "reasoning":
        raise ValueError(f"unknown dialect {dialect!r}")
    limit = max_tokens if enabled else None
    level = {None: "high", False: "none", True: effort or "high"}[enabled]
    return [
        F.struct(
            F.lit(exclude if enabled else False).alias("exclude"),
            F.lit(limit).cast("int").alias("max_tokens"),
            F.lit(level if limit is None else None).cast("string").alias("effort"),
        ).alias("reasoning")
    ]


def _settings(
    stream: bool, temperature: float | None, max_tokens: int | None, top_p: float | None, extra: list[Column]
) -> list[Column]:
    # to_json leaves null fields out.
    return [
        F.lit(stream).alias("stream"),
        F.lit(temperature).cast("double").alias("temperature"),
        F.lit(max_tokens).cast("int").alias("max_tokens"),
        F.lit(top_p).cast("double").alias("top_p"),
        *extra,
    ]


def request_body(
    model: str,
    messages: Column,
    dialect: str = "thinking",
    stream: bool = False,
    temperature: float | None = TEMPERATURE,
    max_tokens: int | None = None,
    top_p: float | None = None,
    thinking: bool | None = None,
    effort: str | None = None,
    thinking_tokens: int | None = None,
    exclude: bool = False,
) -> Column:
    """JSON body of one request from its array of messages."""
    extra = _reasoning_fields(dialect, thinking, effort, thinking_tokens, exclude)
    rest = _settings(stream, temperature, max_tokens, top_p, extra)
    return F.to_json(F.struct(F.lit(model).alias("model"), messages.alias("messages"), *rest))


def conversation_requests(
    history: DataFrame,
    model: str,
    system: str,
    dialect: str = "thinking",
    temperature: float | None = TEMPERATURE,
    max_tokens: int | None = ANSWER_TOKENS,
    thinking: bool | None = None,
    effort: str | None = None,
    files: DataFrame | None = None,
) -> DataFrame:
    """(conv_id, part, body): each conversation's request body, in parts.

    The parts of a conversation joined in order are the JSON body. Part -1 opens it with
    the system message, part k holds turns 64k to 64k+63, the last part closes it. So no
    task ever holds more than 64 turns, however long a conversation is.

    `files`: (conv_id, ord, path, content), ord from 0, what is attached to a conversation. They make one system
    message in front of all others; its JSON string is written across parts, one for each file, below -2.
    """
    first = F.to_json(message("system", F.lit(system)))
    head_json = F.to_json(F.struct(F.lit(model).alias("model")))
    start = F.concat(F.regexp_replace(head_json, r"\}$", ""), F.lit(',"messages":['))
    opening = F.concat(start, first) if files is None else first
    extra = _reasoning_fields(dialect, thinking, effort, None, False)
    tail_json = F.to_json(F.struct(*_settings(False, temperature, max_tokens, None, extra)))
    closing = F.concat(F.lit("],"), F.substring(tail_json, F.lit(2), F.length(tail_json)))
    said = history.where(F.col("role") != "system").select(
        "conv_id",
        F.floor(F.col("turn") / TURNS_PER_PART).alias("part"),
        "turn",
        F.to_json(F.struct("role", "content")).alias("json"),
    )
    body = said.groupBy("conv_id", "part").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("turn", "json"))), lambda m: F.concat(F.lit(","), m["json"])),
            "",
        ).alias("body")
    )
    ends = history.groupBy("conv_id").agg(F.max("turn").alias("last")).select(
        "conv_id",
        F.inline(
            F.array(
                F.struct(F.lit(-1).cast("bigint").alias("part"), opening.alias("body")),
                F.struct((F.floor(F.col("last") / TURNS_PER_PART) + 1).alias("part"), closing.alias("body")),
            )
        ),
    )
    if files is None:
        return body.unionByName(ends)
    asked = history.select("conv_id").distinct()
    begin = asked.select("conv_id", F.lit(_FIRST_FILE - 1).alias("part"), start.alias("body"))
    return body.unionByName(ends).unionByName(begin).unionByName(_file_parts(files.join(asked, "conv_id", "left_semi")))


#: Part number of a conversation's first attached file.
_FIRST_FILE = -(1 << 40)


def _file_parts(files: DataFrame) -> DataFrame:
    """(conv_id, part, body): the message of attached files, escaped file by file, and its end."""
    parts = attach_files(
        files.select(F.col("conv_id").alias("request_id"), F.lit(0).alias("position"), F.lit("").alias("role"), F.lit("").alias("content")).limit(0),
        files.withColumnRenamed("conv_id", "request_id"),
    )
    escaped = F.to_json(F.struct(F.coalesce("content", F.lit("")).alias("x")))  # {"x":"..."}
    escaped = F.substring(escaped, F.lit(7), F.length(escaped) - 8)
    head = F.when(F.col("part") == 0, F.lit('{"role":"system","content":"')).otherwise(F.lit(""))
    body = parts.select(F.col("request_id").alias("conv_id"), (F.col("part") + _FIRST_FILE).alias("part"), F.concat(head, escaped).alias("body"))
    end = files.select("conv_id").distinct().select("conv_id", F.lit(-2).cast("bigint").alias("part"), F.lit('"},').alias("body"))
    return body.unionByName(end)


# --- replies -------------------------------------------------------------

_RESPONSE = (
    "choices array<struct<message:struct<content:string>>>, model string, "
    "usage struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>"
)
_CHUNK = "choices array<struct<delta:struct<content:string>>>"
_PREFIX = "data: "


def parse_responses(replies: DataFrame, body: str = "body", empty_is_error: bool = True) -> DataFrame:
    """Add content, model, token counts and is_error from JSON response bodies."""
    parsed = replies.withColumn("__r", F.from_json(quoted(body), _RESPONSE))
    content = F.coalesce(F.get(F.col("__r.choices"), F.lit(0))["message"]["content"], F.lit(""))
    broken = F.try_parse_json(quoted(body)).isNull()
    has_usage = F.array_contains(F.json_object_keys(quoted(body)), "usage")  # a null usage counts as zeros
    out = parsed.withColumn("content", content).withColumn(
        "model", F.coalesce(F.col("__r.model"), F.lit("unknown"))
    )
    for name in ("prompt_tokens", "completion_tokens", "total_tokens"):
        out = out.withColumn(name, F.when(has_usage, F.coalesce(F.col("__r.usage." + name), F.lit(0))))
    empty = F.col("content") == ""
    return out.withColumn("is_error", broken | (empty if empty_is_error else F.lit(False))).drop("__r")


def parse_chunk_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Keep the lines that carry a reply chunk; add its content and the done flag."""
    data = F.when(quoted(line).startswith(_PREFIX), F.substring(quoted(line), F.lit(len(_PREFIX) + 1), F.length(quoted(line))))
    done = F.col("__data") == "[DONE]"
    content = F.get(F.from_json("__data", _CHUNK)["choices"], F.lit(0))["delta"]["content"]
    parsed = lines.withColumn("__data", data).where(F.col("__data").isNotNull())
    return (
        parsed.withColumn("done", done)
        .withColumn("content", F.when(F.col("done"), F.lit("")).otherwise(content))
        .where(F.col("done") | (F.col("content") != ""))
        .drop("__data")
    )


def parse_chunks(payloads: DataFrame, keys: list[str], payload: str = "payload") -> DataFrame:
    """(keys, line_no, content, done): reply chunks out of raw payloads, in line order."""
    lines = payloads.select(
        *keys, F.posexplode(F.split(quoted(payload), "\n")).alias("line_no", "line")
    ).select(*keys, F.col("line_no").cast("bigint").alias("line_no"), strip_space(F.col("line")).alias("line"))
    return parse_chunk_lines(lines.where(F.col("line") != "")).drop("line")


#: Payloads of a reply whose lines are counted together.
_SEQUENCE = 4096


def parse_chunk_stream(payloads: DataFrame, keys: list[str], order: str, payload: str = "payload") -> DataFrame:
    """`parse_chunks` of replies that arrive in payloads cut anywhere, lines and characters included.

    `order` numbers a reply's payloads from 0. A line that payloads share is put together from its pieces; all others
    stay where they are. Line numbers are those of the whole reply: line ends are summed up over stretches of
    payloads, then within a stretch, so a long reply is no one task's work.
    """
    # Bytes as characters of one byte each: a payload may end inside a character.
    data = F.decode(quoted(payload).cast("binary"), "ISO-8859-1")
    cut = payloads.select(*keys, F.col(order).cast("bigint").alias("__seq"), F.split(data, "\n").alias("__lines"))
    cut = cut.withColumn("__stretch", F.floor(F.col("__seq") / _SEQUENCE))
    ends = cut.select(*keys, "__seq", "__stretch", (F.size("__lines") - 1).alias("__ends"))
    per = ends.groupBy(*keys, "__stretch").agg(F.sum("__ends").alias("__ends"))
    earlier = Window.partitionBy(*keys).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)  # one row per stretch
    per = per.select(*keys, "__stretch", F.coalesce(F.sum("__ends").over(earlier), F.lit(0)).alias("__ahead"))
    per = per.select(*[quoted(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__stretch").alias("__s"), "__ahead")
    same = F.col("__stretch") == F.col("__s")
    for i, k in enumerate(keys):
        same = same & quoted(k).eqNullSafe(F.col(f"__k{i}"))
    within = Window.partitionBy(*keys, "__stretch").orderBy("__seq").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.size("__lines") - 1).over(within), F.lit(0))
    lines = cut.withColumn("__before", before).join(per, same).select(
        *keys, "__seq", (F.col("__ahead") + F.col("__before")).alias("__first"), F.size("__lines").alias("__n"), F.posexplode("__lines").alias("__at", "line")
    ).withColumn("line_no", F.col("__first") + F.col("__at"))
    edge = (F.col("__at") == 0) | (F.col("__at") == F.col("__n") - 1)
    pieces = F.array_sort(F.collect_list(F.struct("__seq", "line")))
    joined = lines.where(edge).groupBy(*keys, "line_no").agg(F.array_join(F.transform(pieces, lambda p: p["line"]), "").alias("line"))
    whole = lines.where(~edge).select(*keys, "line_no", "line").unionByName(joined)
    text = F.make_valid_utf8(F.encode("line", "ISO-8859-1").cast("string"))
    whole = whole.select(*keys, F.col("line_no").cast("bigint").alias("line_no"), strip_space(text).alias("line"))
    return parse_chunk_lines(whole.where(F.col("line") != "")).drop("line")


def clean_replies(replies: DataFrame, content: str = "content") -> DataFrame:
    """Trim replies; `is_error` marks empty ones."""
    trimmed = replies.withColumn(content, strip_space(quoted(content)))
    return trimmed.withColumn("is_error", F.coalesce(quoted(content) == "", F.lit(True)))
