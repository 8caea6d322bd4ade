"""The registered queries: every operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablelens.functions import columns as cols, numbers, words
from tablelens.operators import positions, profile as prof, prompts, row_profile as rowprof, text_profile as texts
from tablelens.plans import fixtures
from tablelens.session import scratch_dir, spread
from tablelens.sources import formats, workbook
from tablelens.streaming import running

WIDTH = 80
Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def digits9(c: Column) -> Column:
    """A double cut to nine significant digits, so that summation order does not show."""
    return F.when(c.isNotNull(), F.format_string("%.8e", c).cast("double"))


def shown(p: DataFrame, fields: list[str]) -> DataFrame:
    """Profile rows with doubles rounded and structs spread out."""
    out = []
    for f in fields:
        if f in ("mean", "median", "std_dev", "variance", "min", "max"):
            out.append(digits9(F.col(f)).alias(f))
        elif f in ("skewness", "kurtosis"):
            out.append((F.round(f, 6) + F.lit(0.0)).alias(f))
        elif f == "word_count":
            out += [F.col(f"word_count.{x}").alias(x) for x in ("en_words", "cn_chars", "total")]
        elif f == "top_freq_content":
            out += [F.col("top_freq_content.content").alias("top_content"), F.col("top_freq_content.n").alias("top_n")]
        else:
            out.append(F.col(f))
    return p.select(*out)


QUICK = ["name", "is_numeric", "count", "none_count", "na_count", "zero_count", "non_zero_valid_count", "mean", "min", "max"]
FULL = QUICK + ["is_inferred", "median", "mode", "std_dev", "variance", "skewness", "kurtosis"]
TEXT = ["name", "is_numeric", "count", "none_count", "mode", "word_count", "top_freq_word", "top_freq_content", "longest", "shortest"]


# --- profiles ------------------------------------------------------------


def profile_quick_lineitem(spark, sf):
    return shown(prof.quick_profile(table(spark, sf, "lineitem")), QUICK)


def profile_full_orders(spark, sf):
    return shown(prof.profile(table(spark, sf, "orders")), FULL)


def profile_full_lineitem(spark, sf):
    return shown(prof.profile(table(spark, sf, "lineitem"), columns="0:7"), FULL)


def profile_text_part(spark, sf):
    return shown(prof.profile(table(spark, sf, "part"), columns="p_name,p_brand,p_type"), TEXT)


def profile_text_documents(spark, sf):
    return shown(prof.profile(table(spark, sf, "documents"), columns="text,lang,source"), TEXT)


def mode_all_columns(spark, sf):
    return prof.column_modes(table(spark, sf, "lineitem"))


def event_strings(spark, sf) -> DataFrame:
    """Events as text, with the number inside props and a column that is mostly numbers."""
    e = table(spark, sf, "events")
    k = F.regexp_extract("props", r"(\d+)", 1)
    return e.select(
        F.col("event_id").cast("string").alias("event_id"),
        k.alias("k"),
        F.concat(F.lit(" "), k, F.lit(" ")).alias("padded"),
        F.when(F.col("event_id") % 20 == 0, "n/a").otherwise(k).alias("mostly"),
        F.when(F.col("event_id") % 5 == 0, "1d").otherwise(k).alias("seldom"),
        F.when(F.col("event_id") % 3 != 0, "").otherwise(k).alias("gaps"),
        F.col("event_type"),
        F.lit("").alias("blank"),
    )


def inferred_numeric(spark, sf):
    return shown(prof.profile(event_strings(spark, sf), columns="k,padded,mostly,seldom,gaps"), FULL)


def top_word_by_lang(spark, sf):
    d = spread(table(spark, sf, "documents").select("lang", F.col("text").alias("s"))).withColumn("n", F.lit(1).cast("bigint"))
    return prof.top_words(d, "lang")


def table_shape(spark, sf):
    return prof.shape(table(spark, sf, "lineitem"))


def allstring_report(spark, sf):
    return prof.string_report(event_strings(spark, sf))


def allstring_summary(spark, sf):
    s = prof.string_summary(event_strings(spark, sf))
    return s.select("name", "type", "non_empty", digits9(F.col("mean")).alias("mean"), "min", "max", "zero_count", "en_words", "cn_chars")


def _row_profile_shown(p: DataFrame) -> DataFrame:
    fields = ["name", "dtype", "is_numeric", "count", "mean", "median", "std_dev", "variance", "min", "max"]
    rounded = [
        (F.round(c, 4) + F.lit(0.0)).alias(c) if c in ("mean", "median", "std_dev", "variance", "min", "max") else F.col(c)
        for c in fields
    ]
    return p.select(
        *rounded,
        (F.round("skewness", 4) + F.lit(0.0)).alias("skewness"),
        (F.round("kurtosis", 4) + F.lit(0.0)).alias("kurtosis"),
        "zero_count",
        "non_zero_valid_count",
        F.col("word_count.en_words").alias("en_words"),
        F.col("top_freq_content.content").alias("top_content"),
        F.col("top_freq_content.n").alias("top_n"),
    )


def row_profile(spark, sf):
    """Numeric rows: five numbers of each order, named by key."""
    o = table(spark, sf, "orders").select(
        "o_orderkey",
        F.col("o_custkey").alias("a"),
        (F.col("o_orderkey") % 7).alias("b"),
        (F.col("o_custkey") % 7).alias("c"),
        (F.col("o_orderkey") % 3).alias("d"),
        F.lit(3).cast("bigint").alias("e"),
    )
    return _row_profile_shown(rowprof.row_profile(o, name_column="o_orderkey", name_in_values=False))


def row_profile_mixed(spark, sf):
    """Rows with text, so no row is numeric."""
    o = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", F.col("c_nationkey").cast("string").alias("n"))
    return _row_profile_shown(rowprof.row_profile(o, name_column="c_name"))


def row_profile_numbered(spark, sf):
    """Rows named by position."""
    o = table(spark, sf, "part").select("p_partkey", "p_size")
    return _row_profile_shown(rowprof.row_profile(o, columns="p_size,p_partkey", order_by=["p_partkey"]))


def row_fields(spark, sf):
    c = table(spark, sf, "part")
    return rowprof.row_fields(c, 20, ["p_partkey"])


# --- columns -------------------------------------------------------------


def percent_normalise(spark, sf):
    l = table(spark, sf, "lineitem")
    percent = F.concat(F.round(F.col("l_discount") * 100, 0).cast("int").cast("string"), F.lit("%"))
    mixed = F.when(F.col("l_linenumber") == 1, "none").otherwise(percent)
    df = l.select("l_orderkey", "l_linenumber", percent.alias("discount"), mixed.alias("mixed"))
    return cols.normalise_percent(df)


def select_by_position(spark, sf):
    return cols.select_columns(table(spark, sf, "customer"), "0:2")


def select_by_list(spark, sf):
    return cols.select_columns(table(spark, sf, "customer"), "4,0")


def select_by_name(spark, sf):
    return cols.select_columns(table(spark, sf, "customer"), "c_custkey, c_acctbal")


def number_columns(spark, sf):
    n = cols.number_columns(cols.select_columns(table(spark, sf, "customer"), "0:2"))
    return n.toDF(*[f"c{c}" for c in n.columns])


def truncate_cells(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", F.repeat("p_type", 3).alias("t"))
    return cols.truncate_cells(p, keep=("p_partkey",))


def render_tsv(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("seg"))
    return c.select("c_custkey", cols.render_tsv(c))


def render_numbers(spark, sf):
    p = table(spark, sf, "part")
    return p.select(
        "p_partkey",
        numbers.render_double(F.col("p_retailprice")).alias("price"),
        numbers.render_double(F.col("p_partkey") * 1e9).alias("large"),
        numbers.render_double(F.col("p_size") / 1048576.0).alias("small"),
    )


# --- positions -----------------------------------------------------------


def head_orders(spark, sf):
    return positions.head(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), 5, ["o_orderkey"])


def head_file_order(spark, sf):
    return positions.head(table(spark, sf, "orders"), 5).select("o_orderkey", "o_custkey")


def tail_orders(spark, sf):
    return positions.tail(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), 5, ["o_orderkey"])


def tail_file_order(spark, sf):
    return positions.tail(table(spark, sf, "orders"), 5).select("o_orderkey", "o_custkey")


def row_positions(spark, sf):
    """Positions by (status, key): a leading key that few values share."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return positions.with_position(o, ["o_orderstatus", "o_orderkey"])


def row_positions_file(spark, sf):
    return positions.with_position(table(spark, sf, "lineitem")).select("Row", "l_orderkey", "l_linenumber", "l_extendedprice")


def rows_range(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return positions.rows_between(o, 700, 1200, ["o_orderkey"])


def rows_range_by_price(spark, sf):
    o = table(spark, sf, "orders").select("o_totalprice", "o_orderkey")
    return positions.rows_between(o, 500, 1000, ["o_totalprice", "o_orderkey"])


def rows_specific(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    return positions.rows_at(o, [1400, 3, 3, 750, 10**12], ["o_orderkey"])


LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]


def head_many(spark, sf):
    """More rows than top-n selection takes: from a stored index."""
    return positions.head(table(spark, sf, "lineitem").select(*LINE_KEYS), 150_000, LINE_KEYS)


def tail_many(spark, sf):
    return positions.tail(table(spark, sf, "lineitem").select(*LINE_KEYS), 150_000, LINE_KEYS)


def rows_many(spark, sf):
    return positions.rows_between(table(spark, sf, "lineitem").select(*LINE_KEYS), 1_000, 190_000, LINE_KEYS)


def rows_missing(spark, sf):
    return positions.missing_rows(table(spark, sf, "orders"), [3, 10**12]).select("Row", "total")


def rows_rendered(spark, sf):
    o = table(spark, sf, "part")
    return positions.rows(o, "5,2,2", ["p_partkey"], columns="0:2", truncated=True)


def document_lines(spark, sf) -> DataFrame:
    """Documents as the line table (file, line_no, line)."""
    d = table(spark, sf, "documents")
    return d.select(
        F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    ).select("file", F.col("line_no").cast("bigint").alias("line_no"), "line")


def segment_lines(spark, sf):
    return positions.line_segment(document_lines(spark, sf), 2, 3)


def head_lines(spark, sf):
    return positions.head_lines(document_lines(spark, sf), 7)


def tail_lines(spark, sf):
    return positions.tail_lines(document_lines(spark, sf), 7)


def rows_of_lines(spark, sf):
    return positions.rows_of_lines(document_lines(spark, sf), "3,1,1")


def lines_missing(spark, sf):
    """Lines that short documents do not have."""
    return positions.missing_lines(document_lines(spark, sf), "0,3,3,20")


def rows_of_lines_wrapped(spark, sf):
    return positions.rows_of_lines(document_lines(spark, sf), "0:1", WIDTH)


def line_counts(spark, sf):
    return formats.line_count(document_lines(spark, sf))


# --- texts ---------------------------------------------------------------


def word_counts(spark, sf):
    t = F.col("text")
    return spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", words.en_words(t).alias("en_words"), words.cn_chars(t).alias("cn_chars"), words.total_words(t).alias("total"))


def word_counts_nopunct(spark, sf):
    t = F.col("text")
    return table(spark, sf, "pages").select(
        "page_id", words.en_words(F.col("html")).alias("en_words"), words.total_words_no_punct(F.col("html")).alias("bare_words"),
        F.char_length(words.clean_punct(F.col("html"))).cast("bigint").alias("bare_chars"),
    )


def mixed_script(spark, sf):
    """Han counts and widths: digits of every document turned into Han characters."""
    t = F.translate("text", "aeiou", "一二三四五")
    d = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", t.alias("t"))
    c = F.col("t")
    return d.select("doc_id", words.cn_chars(c).alias("cn_chars"), words.total_words(c).alias("total"), words.display_width(F.replace(c, F.lit("\n"), F.lit(" "))).alias("width"))


def _paragraph_docs(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))


def paragraph_counts(spark, sf):
    return _paragraph_docs(spark, sf).select("doc_id", words.paragraph_count(F.col("text")).alias("paragraphs"))


def paragraph_table(spark, sf):
    return texts.split_paragraphs(_paragraph_docs(spark, sf), ["doc_id"])


def soft_lines(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", words.soft_lines(F.col("text"), WIDTH).alias("soft_lines"))


def wrapped_lines(spark, sf):
    return texts.wrapped(document_lines(spark, sf), ["file", "line_no"], "line", 40)


def wrapped_chars(spark, sf):
    p = table(spark, sf, "pages")
    t = F.concat(F.lit("  "), F.col("url"))
    return p.select("page_id", words.wrap_chars(t, 16).alias("wrapped"), words.wrap_chars(t, 16, first_line=True).alias("first"))


def text_profile(spark, sf):
    return texts.text_profile(_paragraph_docs(spark, sf), ["doc_id"], width=WIDTH)


def text_summary(spark, sf):
    return texts.text_summary(table(spark, sf, "documents"), ["doc_id"], width=WIDTH)


def text_profile_lines(spark, sf):
    lines = _paragraph_docs(spark, sf).select(
        F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    )
    return texts.text_profile_of_lines(lines, "file", WIDTH, chunk=10)


# --- messages ------------------------------------------------------------


def text_context(spark, sf):
    return prompts.text_context(table(spark, sf, "documents"), ["doc_id"])


def preview_context(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return prompts.table_preview(o, ["o_orderkey"])


def paragraph_prompts(spark, sf):
    p = prompts.paragraph_prompts(_paragraph_docs(spark, sf), ["doc_id"])
    return p.select("doc_id", "paragraph_no", "content", "cut", F.col("messages")[0]["role"].alias("role0"), F.col("messages")[0]["content"].alias("system"))


def overview_prompts(spark, sf):
    p = prompts.overview_prompts(table(spark, sf, "documents"), ["doc_id"])
    return p.select("doc_id", "cut", F.col("messages")[1]["role"].alias("role1"), F.col("messages")[1]["content"].alias("user"), F.length(F.col("messages")[0]["content"]).cast("bigint").alias("system_chars"))


def conversation_history(spark, sf):
    return prompts.conversation_messages(table(spark, sf, "conversations"))


def conversation_requests(spark, sf):
    history = prompts.conversation_messages(table(spark, sf, "conversations"))
    return prompts.conversation_requests(history, "model-a", "Be brief.", thinking=True, effort="xhigh")


def pending_requests(spark, sf):
    """Requests that end with the open question, files attached to some of them."""
    history = prompts.conversation_messages(table(spark, sf, "conversations"), pending=True)
    files = table(spark, sf, "benchmark").select(
        F.floor(F.col("item_id") / 2).alias("conv_id"), (F.col("item_id") % 2).alias("ord"),
        F.concat(F.lit("f"), F.col("item_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("content"),
    )
    return prompts.conversation_requests(history, "model-a", "Be brief.", thinking=True, effort="xhigh", files=files)


def request_bodies(spark, sf):
    d = table(spark, sf, "conversations").where(F.col("role") == "user")
    messages = prompts.answer_messages(F.lit("abc"), F.col("text"))
    body = prompts.request_body("model-a", messages, "reasoning", temperature=0.25, max_tokens=500, thinking=True, effort="low")
    j = d.select("conv_id", "turn", body.alias("b"))
    path = lambda p: F.get_json_object("b", p)
    return j.select(
        "conv_id", "turn",
        path("$.model").alias("model"),
        path("$.messages[1].content").alias("user"),
        path("$.messages[0].role").alias("role0"),
        path("$.stream").alias("stream"),
        path("$.temperature").cast("double").alias("temperature"),
        path("$.max_tokens").cast("bigint").alias("max_tokens"),
        path("$.top_p").alias("top_p"),
        path("$.reasoning.effort").alias("effort"),
        path("$.reasoning.exclude").alias("exclude"),
    )


def effort_levels(spark, sf):
    effort = F.element_at(F.array(*[F.lit(e) for e in prompts.EFFORTS]), (F.col("item_id") % 5 + 1).cast("int"))
    return table(spark, sf, "benchmark").select("item_id", effort.alias("effort")).withColumn("level", prompts.effort_level(F.col("effort")))


def attach_files(spark, sf):
    c = table(spark, sf, "conversations")
    messages = c.select(F.col("conv_id").alias("request_id"), F.col("turn").alias("position"), "role", F.col("text").alias("content"))
    b = table(spark, sf, "benchmark")
    files = b.select(
        F.floor(F.col("item_id") / 2).alias("request_id"), (F.col("item_id") % 2).alias("ord"),
        F.concat(F.lit("f"), F.col("item_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("content"),
    )
    return prompts.attach_files(messages, files)


def _reply_bodies(spark, sf) -> DataFrame:
    """Replies as a model would send them: every fourth empty, every fifth without usage."""
    c = table(spark, sf, "conversations").where(F.col("role") == "assistant")
    content = F.when(F.col("conv_id") % 4 == 0, "").otherwise(F.col("text"))
    usage = F.when(
        F.col("conv_id") % 5 != 0,
        F.struct(F.col("turn").alias("prompt_tokens"), F.length("text").cast("bigint").alias("completion_tokens")),
    )
    good = F.to_json(
        F.struct(
            F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices"),
            F.when(F.col("conv_id") % 3 != 0, "model-a").alias("model"),
            usage.alias("usage"),
        )
    )
    return c.select("conv_id", "turn", F.when(F.col("conv_id") % 7 == 0, "not json").otherwise(good).alias("body"))


def parse_responses(spark, sf):
    return prompts.parse_responses(_reply_bodies(spark, sf)).drop("body")


def parse_chunks(spark, sf):
    """Replies cut into one chunk per text line, with noise around them."""
    c = table(spark, sf, "conversations").where(F.col("role") == "assistant")
    chunk = lambda x: F.concat(
        F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(x.alias("content")).alias("delta"))).alias("choices"))), F.lit("\r\n\r\n")
    )
    payload = F.concat(
        F.lit(": hello\ndata: {broken\n"), F.array_join(F.transform(F.split("text", "\n"), chunk), ""), F.lit("data: [DONE]\n")
    )
    return prompts.parse_chunks(c.select("conv_id", "turn", payload.alias("payload")), ["conv_id", "turn"])


def parse_chunk_stream(spark, sf):
    """The same replies in payloads of 97 bytes, which end inside lines and characters."""
    c = table(spark, sf, "conversations").where(F.col("role") == "assistant")
    chunk = lambda x: F.concat(
        F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(x.alias("content")).alias("delta"))).alias("choices"))), F.lit("\r\n\r\n")
    )
    whole = F.concat(F.lit(": hello\ndata: {broken\n"), F.array_join(F.transform(F.split("text", "\n"), chunk), ""), F.lit("data: [DONE]\n"))
    places = F.sequence(F.lit(0), F.floor((F.octet_length("whole") - 1) / 97).cast("int"))
    cut = c.select("conv_id", "turn", whole.cast("binary").alias("whole")).select("conv_id", "turn", "whole", F.explode(places).alias("seq"))
    pieces = cut.select("conv_id", "turn", "seq", F.substring("whole", F.col("seq") * 97 + 1, F.lit(97)).alias("payload"))
    return prompts.parse_chunk_stream(pieces, ["conv_id", "turn"], "seq")


def clean_replies(spark, sf):
    c = table(spark, sf, "conversations").where(F.col("role") == "assistant")
    padded = F.when(F.col("conv_id") % 4 == 0, " \t\n").otherwise(F.concat(F.lit("\n "), F.col("text"), F.lit(" 　")))
    return prompts.clean_replies(c.select("conv_id", "turn", padded.alias("content")))


# --- files ---------------------------------------------------------------


def _folder(spark, label: str) -> str:
    return scratch_dir(spark, label)


def roundtrip_csv(spark, sf):
    f = _folder(spark, "csv")
    table(spark, sf, "customer").write.option("header", True).csv(f + "/t.csv")
    return formats.read_table(spark, f + "/t.csv")


def roundtrip_tsv(spark, sf):
    f = _folder(spark, "tsv")
    table(spark, sf, "part").write.option("header", True).option("sep", "\t").csv(f + "/t.TSV")
    return formats.read_table(spark, f + "/t.TSV")


def roundtrip_forced_csv(spark, sf):
    f = _folder(spark, "dat")
    table(spark, sf, "supplier").write.option("header", True).option("sep", "|").csv(f + "/t.dat")
    return formats.read_table(spark, f + "/t.dat", format="csv", sep="|")


def roundtrip_headerless(spark, sf):
    f = _folder(spark, "nohead")
    table(spark, sf, "nation").write.csv(f + "/t.csv")
    return formats.read_records(spark, f + "/t.csv", header=False)


def _customer_records(spark, sf) -> DataFrame:
    """Customers as all-string CSV records; one file per partition, in key order."""
    f = _folder(spark, "records")
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    c.repartitionByRange(4, "c_custkey").sortWithinPartitions("c_custkey").write.option("header", True).csv(f + "/t.csv")
    return formats.read_records(spark, f + "/t.csv")


def records_head(spark, sf):
    return positions.head(_customer_records(spark, sf), 7)


def records_tail(spark, sf):
    return positions.tail(_customer_records(spark, sf), 7)


def records_rows(spark, sf):
    return positions.rows(_customer_records(spark, sf), "40:90", columns="c_name,c_custkey")


def numbered_file_lines(spark, sf):
    """Line numbers within each of several files of lines."""
    # The status leads the sort: a writer that has to sort by it itself drops the order by key.
    f = _folder(spark, "numbered")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.concat_ws(" ", F.col("o_orderkey").cast("string"), "o_orderpriority").alias("value"))
    o.repartition(3, "o_orderstatus").sortWithinPartitions("o_orderstatus", "o_orderkey").select("o_orderstatus", "value").write.partitionBy("o_orderstatus").text(f)
    lines = formats.read_lines(spark, f)
    status = F.regexp_extract("file", "o_orderstatus=([^/]+)/", 1)
    return lines.select(status.alias("status"), "line_no", "line")


def roundtrip_ragged(spark, sf):
    """Records whose number of fields varies with the key."""
    f = _folder(spark, "ragged")
    p = table(spark, sf, "part")
    extra = F.array_join(F.array_repeat(F.lit("x"), (F.col("p_partkey") % 3).cast("int")), ",")
    line = F.concat_ws(",", F.col("p_partkey").cast("string"), F.concat(F.lit('"'), F.col("p_name"), F.lit(', ""q"""')), F.nullif(extra, F.lit("")))
    p.select(line.alias("value")).write.text(f)
    r = formats.read_ragged(spark, f, header=False)
    return r.select(
        F.col("fields")[0].cast("bigint").alias("p_partkey"), F.col("fields")[1].alias("name"), F.array_size("fields").cast("bigint").alias("n")
    )


def roundtrip_multiline(spark, sf):
    """Whole texts with their line ends in quoted fields, inch marks in plain ones."""
    f = _folder(spark, "multiline")
    quoted = F.concat(F.lit('"'), F.replace(F.coalesce("text", F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", F.col("doc_id").cast("string"), F.lit('5" pipe'), quoted, F.lit('6"'))
    table(spark, sf, "documents").select(line.alias("value")).write.text(f)
    r = formats.read_records(spark, f, header=False)
    return r.select(F.col("column_0").cast("bigint").alias("doc_id"), F.col("column_1").alias("size"), F.col("column_2").alias("text"), F.col("column_3").alias("width"))


def record_fields(spark, sf):
    """Fields and words of the first records, whose number of fields varies and whose names hold line ends."""
    f = _folder(spark, "fields")
    p = table(spark, sf, "part")
    extra = F.array_join(F.array_repeat(F.lit("x"), (F.col("p_partkey") % 3).cast("int")), ",")
    name = F.concat(F.lit('"'), F.replace("p_name", F.lit(" "), F.lit("\n")), F.lit('"'))
    line = F.concat_ws(",", F.col("p_partkey").cast("string"), name, F.nullif(extra, F.lit("")))
    p.orderBy("p_partkey").coalesce(1).select(line.alias("value")).write.text(f)
    return rowprof.record_fields(formats.read_ragged(spark, f, header=False)).drop("file")


def roundtrip_json(spark, sf):
    f = _folder(spark, "json")
    table(spark, sf, "supplier").write.json(f + "/t.jsonl")
    return formats.read_table(spark, f + "/t.jsonl").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")


def roundtrip_parquet(spark, sf):
    return formats.read_table(spark, f"{sf}/supplier.parquet")


def roundtrip_ipc(spark, sf):
    f = _folder(spark, "ipc")
    fixtures.write_ipc(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_custkey"), f)
    return formats.read_table(spark, f, format="ipc")


def roundtrip_xlsx(spark, sf):
    f = _folder(spark, "xlsx")
    p = table(spark, sf, "part")
    share = F.concat((F.col("p_partkey") % 100).cast("string"), F.lit("%"))
    flag = F.col("p_size") > 25
    fixtures.write_xlsx(p.select("p_partkey", "p_name", "p_retailprice", share.alias("share"), flag.alias("big")), f)
    return formats.read_table(spark, f, format="excel")


def fill_merged_cells(spark, sf):
    """One sheet with a row per part; the first column is merged over four rows each."""
    p = table(spark, sf, "part").where(F.col("p_partkey").isNotNull())
    place = [F.lit("f").alias("file"), F.lit("s").alias("sheet"), F.col("p_partkey").cast("int").alias("r")]
    kind = F.lit("string").alias("cell_type")
    top = p.where(F.col("p_partkey") % 4 == 0).select(*place, F.lit(0).alias("c"), kind, F.col("p_type").alias("value"))
    names = p.select(*place, F.lit(1).alias("c"), kind, F.col("p_name").alias("value"))
    r0 = F.col("p_partkey").cast("int")
    regions = p.where(F.col("p_partkey") % 4 == 0).select(
        F.lit("f").alias("file"), F.lit("s").alias("sheet"), r0.alias("r0"), F.lit(0).alias("c0"), (r0 + 3).alias("r1"), F.lit(0).alias("c1")
    )
    filled = workbook.fill_merged(top.unionByName(names), regions)
    return filled.select(F.col("r").cast("bigint").alias("r"), F.col("c").cast("bigint").alias("c"), "value")


def cell_column_types(spark, sf):
    """Columns of cells whose types follow from the event, one kind of mix per column."""
    e = table(spark, sf, "events")
    column, odd = F.col("event_id") % 8, (F.col("event_id") / 8).cast("bigint") % 2 == 1
    kinds = ["bool", "int", "int", "date", "string", "string", "error", "float"]
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (column + 1).cast("int"))
    kind = F.when((column == 2) & odd, "float").when((column == 5) & odd, "int").when((column == 7) & odd, "bool").otherwise(kind)
    value = F.when(column == 4, F.concat(F.regexp_extract("props", r"(\d+)", 1), F.lit("%"))).otherwise(F.lit("1"))
    return workbook.column_types(e.select(column.alias("c"), kind.alias("cell_type"), value.alias("value")))


def roundtrip_lines(spark, sf):
    f = _folder(spark, "text")
    d = table(spark, sf, "documents").where("text <> ''")
    d.select(F.replace("text", F.lit("\n"), F.lit("\r\n")).alias("value")).write.text(f)
    lines = formats.read_lines(spark, f)
    return lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"))


def roundtrip_whole_text(spark, sf):
    f = _folder(spark, "whole")
    table(spark, sf, "benchmark").select("text").write.text(f)
    whole = formats.read_text(spark, f)
    return whole.agg(F.sum(F.array_size(F.split("text", "\n")) - 1).alias("lines"), F.sum(words.en_words(F.col("text"))).alias("en_words"))


def format_detection(spark, sf):
    """Formats by ending; every tenth page gets the same one."""
    endings = ["csv", "TSV", "json", "ndjson", "JSONL", "ipc", "arrow", "parquet", "xlsx", "md"]
    ending = F.element_at(F.array(*[F.lit(e) for e in endings]), (F.col("page_id") % 10 + 1).cast("int"))
    p = table(spark, sf, "pages")
    return p.select("page_id", formats.detected_format(F.concat(F.lit("/data/p."), "page_id", F.lit("."), ending)).alias("format"))


# --- streams -------------------------------------------------------------


def _event_stream(spark, sf) -> DataFrame:
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def _run(spark, stream: DataFrame, label: str, mode: str) -> str:
    f = _folder(spark, label)
    running.write_batches(stream, f + "/out", f + "/state", mode).awaitTermination()
    return f + "/out"


def stream_profile(spark, sf):
    e = _event_stream(spark, sf).select(
        F.col("event_id").cast("string").alias("event_id"), F.col("value").cast("string").alias("value"), "event_type", "props"
    )
    s = running.read_latest(spark, _run(spark, running.running_summary(e), "stream", "complete"))
    return s.select("name", "type", "non_empty", digits9(F.col("mean")).alias("mean"), "min", "max", "zero_count", "en_words", "cn_chars")


def stream_window_profile(spark, sf):
    e = _event_stream(spark, sf).select(
        F.timestamp_micros(numbers.clock_micros(F.col("ts"))).alias("ts"), F.col("value").cast("string").alias("value"), "event_type"
    )
    out = _run(spark, running.windowed_summary(e, "ts", "1 day", "1 hour"), "windows", "append")
    s = running.read_appended(spark, out)
    return s.select(F.unix_seconds("window_start").alias("window_start"), "name", "type", "non_empty", digits9(F.col("mean")).alias("mean"), "min", "max", "en_words")


def stream_words(spark, sf):
    f = _folder(spark, "stream-lines")
    table(spark, sf, "documents").where("text <> ''").select("text").write.text(f)
    return running.read_latest(spark, _run(spark, running.running_words(running.stream_lines(spark, f)), "words", "complete"))


def stream_top_values(spark, sf):
    f = _folder(spark, "top")
    events = table(spark, sf, "events")
    events.repartition(10).write.parquet(f + "/in")  # ten files, one per micro-batch
    e = running.stream_records(spark, f + "/in", events.schema, "parquet", files_per_batch=1)
    running.count_values(e, ["event_type", "props", "user_id"], f + "/out", f + "/state", fanout=3).awaitTermination()
    return running.top_values(spark, f + "/out")


def stream_first_rows(spark, sf):
    first = running.first_rows(_event_stream(spark, sf).select("event_id"), 5)
    return running.read_appended(spark, _run(spark, first, "first", "append")).agg(F.count(F.lit(1)).alias("rows"))


QUERIES: list[Query] = [
    profile_quick_lineitem, profile_full_orders, profile_full_lineitem, profile_text_part,
    profile_text_documents, mode_all_columns, inferred_numeric, top_word_by_lang, table_shape,
    allstring_report, allstring_summary, row_profile, row_profile_mixed, row_profile_numbered, row_fields,
    percent_normalise, select_by_position, select_by_list, select_by_name, number_columns,
    truncate_cells, render_tsv, render_numbers,
    head_orders, head_file_order, tail_orders, tail_file_order, row_positions, row_positions_file,
    rows_range, rows_range_by_price, rows_specific, rows_missing, rows_rendered,
    head_many, tail_many, rows_many, lines_missing,
    segment_lines, head_lines, tail_lines, rows_of_lines, rows_of_lines_wrapped, line_counts,
    word_counts, word_counts_nopunct, mixed_script, paragraph_counts, paragraph_table, soft_lines,
    wrapped_lines, wrapped_chars, text_profile, text_summary, text_profile_lines,
    text_context, preview_context, paragraph_prompts, overview_prompts, conversation_history,
    conversation_requests, request_bodies, effort_levels, attach_files, parse_responses, parse_chunks,
    clean_replies, pending_requests, parse_chunk_stream,
    roundtrip_csv, roundtrip_tsv, roundtrip_forced_csv, roundtrip_headerless, roundtrip_ragged,
    roundtrip_multiline, record_fields,
    records_head, records_tail, records_rows, numbered_file_lines, fill_merged_cells, cell_column_types,
    roundtrip_json, roundtrip_parquet, roundtrip_ipc, roundtrip_xlsx, roundtrip_lines,
    roundtrip_whole_text, format_detection,
    stream_profile, stream_window_profile, stream_words, stream_top_values, stream_first_rows,
]


def registered() -> dict[str, Query]:
    return {q.__name__: q for q in QUERIES}
