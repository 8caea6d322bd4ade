"""Profiles of texts, whole in a cell or spread over lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tablelens.functions.columns import quoted
from tablelens.functions.words import (
    clean_punct,
    cn_chars,
    en_words,
    not_blank,
    paragraph_count,
    paragraphs,
    soft_lines,
    wrap_lines,
)
from tablelens.session import spread

DEFAULT_WIDTH = 80
# Lines per chunk when a text is profiled from its lines.
CHUNK = 100_000


def _unix_lines(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Keys and text, with '\\r\\n' as '\\n', as reading by lines gives it."""
    return docs.select(*keys, F.replace(quoted(text), F.lit("\r\n"), F.lit("\n")).alias(text))


def text_profile(docs: DataFrame, keys: list[str], text: str = "text", width: int = DEFAULT_WIDTH) -> DataFrame:
    """Words, soft lines and paragraphs of every text; one narrow pass."""
    t = quoted(text)
    measured = spread(_unix_lines(docs, keys, text)).select(
        *keys,
        en_words(t).alias("en_words"),
        cn_chars(t).alias("cn_chars"),
        soft_lines(t, width).alias("soft_lines"),
        paragraph_count(t).alias("paragraphs"),
    )
    return measured.withColumn("total", F.col("en_words") + F.col("cn_chars"))


def text_summary(docs: DataFrame, keys: list[str], text: str = "text", width: int = DEFAULT_WIDTH) -> DataFrame:
    """text_profile plus the counts with ASCII punctuation taken out first."""
    bare = spread(_unix_lines(docs, keys, text)).select("*", clean_punct(quoted(text)).alias("__bare"))
    t, b = quoted(text), F.col("__bare")
    return bare.select(
        *keys,
        en_words(t).alias("en_words"),
        en_words(b).alias("en_words_no_punct"),
        cn_chars(t).alias("cn_chars"),
        cn_chars(b).alias("cn_chars_no_punct"),
        soft_lines(t, width).alias("soft_lines"),
        paragraph_count(t).alias("paragraphs"),
    )


def split_paragraphs(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, paragraph_no, paragraph): the non-blank paragraphs, numbered from 1."""
    mine = spread(_unix_lines(docs, keys, text))
    return mine.select(*keys, F.posexplode(paragraphs(quoted(text))).alias("i", "paragraph")).select(
        *keys, (F.col("i") + 1).cast("bigint").alias("paragraph_no"), "paragraph"
    )


def wrapped(docs: DataFrame, keys: list[str], text: str = "line", width: int = DEFAULT_WIDTH) -> DataFrame:
    """(keys, part, line): every logical line as its soft-wrapped lines."""
    mine = spread(docs.select(*keys, quoted(text)))
    return mine.select(*keys, F.posexplode(wrap_lines(quoted(text), width)).alias("part", "line")).select(
        *keys, F.col("part").cast("bigint").alias("part"), "line"
    )


def text_profile_of_lines(
    lines: DataFrame, key: str = "file", width: int = DEFAULT_WIDTH, chunk: int = CHUNK
) -> DataFrame:
    """text_profile from a table (key, line_no, line), for texts too large for one cell.

    Words and wrapped lines add up over lines. What depends on earlier lines, the start of
    a paragraph and whether a blank line counts, only looks back to the last line of some
    kind; chunks of a text are worked on apart and a running maximum over one row per
    chunk joins them. So a text that holds a third of all lines is spread over many tasks.
    """
    line = F.col("line")
    at = F.col("line_no")
    kind = F.when(line == "", "empty").when(not_blank(line), "full").otherwise("blank")
    rows = spread(lines.select(key, "line_no", "line")).select(
        F.col(key),
        at,
        F.floor(at / chunk).alias("chunk"),
        kind.alias("kind"),
        en_words(line).alias("en"),
        cn_chars(line).alias("cn"),
        F.when(not_blank(line), soft_lines(line, width)).otherwise(F.lit(0)).alias("soft"),
    )
    before = Window.partitionBy(key, "chunk").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    full, empty = F.when(F.col("kind") == "full", at), F.when(F.col("kind") == "empty", at)
    filled = F.when(F.col("kind") != "empty", at)
    seen = rows.select(
        "*",
        full.alias("full_at"),
        empty.alias("empty_at"),
        filled.alias("filled_at"),
        F.max(full).over(before).alias("prev_full"),
        F.max(empty).over(before).alias("prev_empty"),
        F.max(filled).over(before).alias("prev_filled"),
    )
    is_full, is_blank = F.col("kind") == "full", F.col("kind") == "blank"
    # The first full line of a chunk, and its first line that is not empty, have to wait
    # for what earlier chunks held.
    opens = is_full & F.col("prev_full").isNotNull() & (F.col("prev_empty") > F.col("prev_full"))
    first_full = is_full & F.col("prev_full").isNull()
    first_blank = is_blank & F.col("prev_filled").isNull()
    # A blank line counts unless it opens a paragraph. Newlines pair up from the left, so
    # after k empty lines that is the case for odd k, and at the start of a text for even k.
    gap_is_even = (at - F.col("prev_filled") - 1) % 2 == 0
    chunks = seen.groupBy(key, "chunk").agg(
        F.sum("en").alias("en"),
        F.sum("cn").alias("cn"),
        F.sum("soft").alias("soft"),
        F.count_if(opens).alias("opened"),
        F.count_if(is_blank & F.col("prev_filled").isNotNull() & gap_is_even).alias("blanks"),
        F.max("full_at").alias("full_at"),
        F.max("empty_at").alias("empty_at"),
        F.max("filled_at").alias("filled_at"),
        F.max(F.when(first_full, at)).alias("first_full"),
        F.max(F.when(first_full, F.col("prev_empty"))).alias("first_full_empty"),
        F.max(F.when(first_blank, at)).alias("first_blank"),
    )
    earlier = Window.partitionBy(key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    joined = chunks.select(
        "*",
        F.max("full_at").over(earlier).alias("carry_full"),
        F.max("empty_at").over(earlier).alias("carry_empty"),
        F.max("filled_at").over(earlier).alias("carry_filled"),
    )
    last_empty = F.greatest("first_full_empty", "carry_empty")
    opens_here = F.col("first_full").isNotNull() & (
        F.col("carry_full").isNull() | (last_empty > F.col("carry_full"))
    )
    first = F.col("first_blank")
    blank_here = first.isNotNull() & F.when(
        F.col("carry_filled").isNull(), first % 2 == 1
    ).otherwise((first - F.col("carry_filled") - 1) % 2 == 0)
    return joined.groupBy(key).agg(
        F.sum("en").alias("en_words"),
        F.sum("cn").alias("cn_chars"),
        (F.sum("soft") + F.sum("blanks") + F.count_if(blank_here)).alias("soft_lines"),
        (F.sum("opened") + F.count_if(F.coalesce(opens_here, F.lit(False)))).alias("paragraphs"),
        (F.sum("en") + F.sum("cn")).alias("total"),
    )
