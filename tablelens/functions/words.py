"""Text measures as Column expressions: words, widths, wrapping, paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Unicode White_Space. Java's bare \s and Spark's trim know ASCII only.
SPACE = r"[\t-\r\x85\p{Z}]"
NOT_SPACE = r"[^\t-\r\x85\p{Z}]"
NOT_EN = r"\P{Alnum}"  # ASCII letters and digits; the named class is the fast one
HAN = r"\p{IsHan}"
PUNCT = r"\p{Punct}"  # ASCII punctuation only, also in Java
NOT_ALNUM = r"[^\p{IsAlphabetic}\p{N}]"

# Terminal cells: East Asian Wide and Fullwidth characters take two; combining marks,
# format characters, Hangul medial and final jamo and controls take none. Fixed values,
# as inclusive code point ranges. A joined emoji sequence is summed part by part.
WIDE_RANGES = (
    "1100-115F 231A-231B 2329-232A 23E9-23EC 23F0 23F3 25FD-25FE 2614-2615 2648-2653 267F "
    "2693 26A1 26AA-26AB 26BD-26BE 26C4-26C5 26CE 26D4 26EA 26F2-26F3 26F5 26FA 26FD 2705 "
    "270A-270B 2728 274C 274E 2753-2755 2757 2795-2797 27B0 27BF 2B1B-2B1C 2B50 2B55 "
    "2E80-303E 3041-3247 3250-A4CF A960-A97C AC00-D7A3 F900-FAFF FE10-FE19 FE30-FE6F FF01-FF60 "
    "FFE0-FFE6 16FE0-18CFF 1B000-1B2FF 1F004 1F0CF 1F18E 1F191-1F19A 1F200-1F320 "
    "1F32D-1F335 1F337-1F37C 1F37E-1F393 1F3A0-1F3CA 1F3CF-1F3D3 1F3E0-1F3F0 1F3F4 "
    "1F3F8-1F43E 1F440 1F442-1F4FC 1F4FF-1F53D 1F54B-1F54E 1F550-1F567 1F57A 1F595-1F596 "
    "1F5A4 1F5FB-1F64F 1F680-1F6C5 1F6CC 1F6D0-1F6D2 1F6D5-1F6D7 1F6DC-1F6DF 1F6EB-1F6EC "
    "1F6F4-1F6FC 1F7E0-1F7EB 1F7F0 1F90C-1F93A 1F93C-1F945 1F947-1F9FF 1FA70-1FAFF 20000-3FFFD"
)
ZERO_RANGES = "1160-11FF 200B-200F 2028-202E 2060-206F FEFF"


def _char_class(ranges: str) -> str:
    return "".join("-".join(rf"\x{{{end}}}" for end in r.split("-")) for r in ranges.split())


WIDE = rf"[{_char_class(WIDE_RANGES)}&&[^\p{{Mn}}\p{{Me}}]]"
ZERO = rf"[\p{{Mn}}\p{{Me}}\p{{Cc}}{_char_class(ZERO_RANGES)}]"
ODD_WIDTH = f"(?:{WIDE}|{ZERO})"
# The bulk of Chinese, Japanese and Korean text, all of it wide: a few ranges are quick to test.
COMMON_WIDE = r"[\u30A0-\u3247\u3250-\u9FFF\uAC00-\uD7A3]"
# Characters that may take none or two cells; anything else is known to take one. One
# positive class is a cheap test, so the long range lists are only tried on what it finds.
ODDISH = (
    r"\x00-\x08\x0E-\x1F\x7F-\x84\x86-\x9F\u0300-\u036F\u0483-\u0489\u0591-\u200F"
    r"\u2028-\uFFFF\x{10000}-\x{10FFFF}"
)
LINE_SPACE = r"\t-\r"  # zero cells in a width, but never inside a word
BLANK = r"[\t\x0B\f\r\x85\p{Z}]"  # white space that does not end a line


def strip_space(c: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def not_blank(c: Column) -> Column:
    """Does a text hold anything but white space? The first character mostly decides."""
    start = F.left(c, F.lit(1))
    return F.when((start > " ") & (start < "\x7f"), F.lit(True)).otherwise(c.rlike(NOT_SPACE))


def strip_leading(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+", "")


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("bigint")


def _count_chars(c: Column, char_class: str) -> Column:
    """Characters of a class, by what a text loses with them; no match is kept."""
    return (F.char_length(c) - F.char_length(F.regexp_replace(c, f"{char_class}+", ""))).cast("bigint")


# --- words ---------------------------------------------------------------


def en_words(c: Column) -> Column:
    """Runs of ASCII letters and digits.

    Counted as the pieces between the other characters, which is twice as fast as
    collecting the matches; the empty pieces at both ends are taken off.
    """
    pieces = F.array_size(F.split(c, NOT_EN + "+"))
    one = F.lit(1)
    ends = F.left(c, one).rlike(NOT_EN).cast("int") + F.right(c, one).rlike(NOT_EN).cast("int")
    return F.when(c == "", F.lit(0)).otherwise(pieces - ends).cast("bigint")


def cn_chars(c: Column) -> Column:
    """Characters of the Han script. Text without any non-ASCII byte is not searched."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lit(0).cast("bigint")).otherwise(_count_chars(c, HAN))


def total_words(c: Column) -> Column:
    return en_words(c) + cn_chars(c)


def word_count(c: Column) -> Column:
    """struct<en_words, cn_chars, total>."""
    return F.struct(
        en_words(c).alias("en_words"), cn_chars(c).alias("cn_chars"), total_words(c).alias("total")
    )


def clean_punct(c: Column) -> Column:
    """Drop ASCII punctuation."""
    return F.regexp_replace(c, PUNCT, "")


def total_words_no_punct(c: Column) -> Column:
    return total_words(clean_punct(c))


def split_words(c: Column) -> Column:
    """White-space separated words as an array, empties dropped."""
    return F.filter(F.split(c, f"{SPACE}+"), lambda w: w != "")


def bare_word(c: Column) -> Column:
    """A word reduced to its letters and digits."""
    return F.regexp_replace(c, NOT_ALNUM, "")


def display_width(c: Column) -> Column:
    """Terminal cells taken by a text: wide characters count 2, zero-width ones 0."""
    cells = F.char_length(c).cast("bigint")
    odd = f"[{LINE_SPACE}{ODDISH}]"
    others = F.regexp_replace(c, f"[^{LINE_SPACE}{ODDISH}]+|{COMMON_WIDE}+", "")
    wide = _count_chars(c, COMMON_WIDE) + _count_chars(others, WIDE)
    return F.when(c.rlike(odd), cells + wide - _count_chars(others, ZERO)).otherwise(cells)


def has_odd_width(c: Column) -> Column:
    """Does any character other than white space take none or two cells?"""
    return c.rlike(f"[{ODDISH}]") & F.regexp_replace(c, f"[^{ODDISH}]+", "").rlike(ODD_WIDTH)


# --- wrapping by words ---------------------------------------------------


def _greedy(width: int) -> str:
    # The longest prefix of at most `width` characters that ends at a blank or at the
    # end; a first word that is longer than that stands alone.
    return rf".{{1,{width}}}(?: |$)|\S+(?: |$)"


def _fold_words(c: Column, width: int) -> Column:
    """Greedy lines of `c` when characters differ in width: one fold over its words."""
    start = F.struct(
        F.array().cast("array<string>").alias("lines"),
        F.lit(None).cast("string").alias("cur"),
        F.lit(0).cast("bigint").alias("used"),
    )

    def place(acc: Column, word: Column) -> Column:
        fits = acc["used"] + 1 + word["cells"] <= width
        return (
            F.when(
                acc["cur"].isNull(),
                F.struct(acc["lines"].alias("lines"), word["text"].alias("cur"), word["cells"].alias("used")),
            )
            .when(
                fits,
                F.struct(
                    acc["lines"].alias("lines"),
                    F.concat_ws(" ", acc["cur"], word["text"]).alias("cur"),
                    (acc["used"] + 1 + word["cells"]).alias("used"),
                ),
            )
            .otherwise(
                F.struct(
                    F.concat(acc["lines"], F.array(acc["cur"])).alias("lines"),
                    word["text"].alias("cur"),
                    word["cells"].alias("used"),
                )
            )
        )

    return F.aggregate(
        F.transform(split_words(c), lambda w: F.struct(w.alias("text"), display_width(w).alias("cells"))),
        start,
        place,
        lambda acc: F.when(acc["cur"].isNull(), acc["lines"]).otherwise(
            F.concat(acc["lines"], F.array(acc["cur"]))
        ),
    )


def _one_space(c: Column) -> Column:
    return strip_space(F.regexp_replace(c, f"{SPACE}{{2,}}|[{SPACE}&&[^ ]]", " "))


def wrap_lines(c: Column, width: int) -> Column:
    """Soft-wrapped lines of one logical line, as an array.

    Greedy by words; a word wider than `width` stands alone; the leading indent is put
    before every line and does not count. Inner white space collapses to one blank.
    Width 0 returns the text as it is. Text of single-cell characters is wrapped by one
    regular expression, other text by a fold over its words.
    """
    if width == 0:
        return F.array(c)
    flat = _one_space(c)
    narrow = F.transform(
        F.regexp_extract_all(flat, F.lit(_greedy(width)), F.lit(0)), lambda line: F.rtrim(line)
    )
    lines = F.when(has_odd_width(flat), _fold_words(c, width)).otherwise(narrow)
    # The indent is measured in bytes, which for blanks and tabs is characters.
    indent = F.octet_length(c) - F.octet_length(strip_leading(c))
    return F.when(indent == 0, lines).otherwise(
        F.transform(lines, lambda line: F.concat(F.repeat(F.lit(" "), indent), line))
    )


def wrap_words(c: Column, width: int) -> Column:
    """`wrap_lines` joined by newlines."""
    return c if width == 0 else F.array_join(wrap_lines(c, width), "\n")


def wrap_chars(c: Column, width: int, first_line: bool = False) -> Column:
    """Wrap by character to `width` cells, the leading indent repeated on every line.

    On the first line of a paragraph the indent comes on top of the visible width.
    """
    if width == 0:
        return c
    body = strip_leading(c)
    indent = F.char_length(c) - F.char_length(body)
    limit = F.lit(width)
    if first_line:
        limit = indent + _visible(body, width)
    cut = F.regexp_extract_all(body, F.concat(F.lit("(?s).{1,"), limit.cast("string"), F.lit("}")), F.lit(0))
    lines = F.when(body.rlike(ODD_WIDTH), _fold_chars(body, limit)).otherwise(cut)
    padded = F.transform(lines, lambda line: F.concat(F.repeat(F.lit(" "), indent), line))
    return F.when(body == "", F.lit("")).otherwise(F.array_join(padded, "\n"))


def _visible(body: Column, width: int) -> Column:
    """Cells of the longest prefix of `body` that fits in `width`."""
    chars = F.split(F.substring(body, 1, width * 4), "")

    def take(acc: Column, ch: Column) -> Column:
        w = display_width(ch)
        fits = ~acc["full"] & (acc["used"] + w <= width)
        return F.struct(
            F.when(fits, acc["used"] + w).otherwise(acc["used"]).alias("used"), (~fits).alias("full")
        )

    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(False).alias("full"))
    folded = F.aggregate(chars, start, take, lambda acc: acc["used"])
    plain = F.least(F.char_length(body), F.lit(width)).cast("bigint")
    return F.when(has_odd_width(body), folded).otherwise(plain)


def _fold_chars(body: Column, limit: Column) -> Column:
    start = F.struct(
        F.array().cast("array<string>").alias("lines"),
        F.lit("").alias("cur"),
        F.lit(0).cast("bigint").alias("used"),
    )

    def place(acc: Column, ch: Column) -> Column:
        w = display_width(ch)
        full = (acc["used"] + w > limit) & (acc["used"] > 0)
        return F.when(
            full,
            F.struct(
                F.concat(acc["lines"], F.array(acc["cur"])).alias("lines"), ch.alias("cur"), w.alias("used")
            ),
        ).otherwise(
            F.struct(
                acc["lines"].alias("lines"),
                F.concat(acc["cur"], ch).alias("cur"),
                (acc["used"] + w).alias("used"),
            )
        )

    return F.aggregate(
        F.split(body, ""), start, place, lambda acc: F.concat(acc["lines"], F.array(acc["cur"]))
    )


# --- paragraphs and lines ------------------------------------------------


def _lines(c: Column) -> Column:
    """Lines of a text: '\\n' or '\\r\\n' ends one, and a final line end opens no further line."""
    return F.split(F.regexp_replace(c, r"\r?\n\z", ""), r"\r?\n")


def soft_lines(c: Column, width: int) -> Column:
    """Line count after wrapping every trimmed line to `width`.

    Per paragraph, a blank first line counts 0 and a later blank line counts 1.
    Texts of single-cell characters are matched whole; others line by line.
    """
    flat = F.regexp_replace(F.regexp_replace(c, f"{BLANK}{{2,}}|[{BLANK}&&[^ ]]", " "), r"(?dm)^ | $", "")
    pattern = r"(?dm)^.+$" if width == 0 else f"(?dm)(?:{_greedy(width)})"
    blank_line = rf"\n{BLANK}+(?:\n|\z)"
    blanks = F.when(c.rlike(blank_line), _over_lines(c, _is_later_blank)).otherwise(F.lit(0).cast("bigint"))

    def wrapped(line: Column, i: Column) -> Column:
        trimmed = strip_space(line)
        n = F.lit(1).cast("bigint") if width == 0 else F.array_size(_fold_words(trimmed, width)).cast("bigint")
        return F.when(trimmed != "", n).otherwise(_is_later_blank(line, i))

    return F.when(has_odd_width(c), _over_lines(c, wrapped)).otherwise(_count(flat, pattern) + blanks)


def _is_later_blank(line: Column, i: Column) -> Column:
    return ((strip_space(line) == "") & (i > 0)).cast("bigint")


def _over_lines(c: Column, measure) -> Column:
    """Sum of measure(line, index in paragraph) over all lines of all paragraphs."""
    zero = F.lit(0).cast("bigint")

    def of_paragraph(acc: Column, para: Column) -> Column:
        counted = F.aggregate(F.transform(_lines(para), measure), zero, lambda a, n: a + n)
        return acc + F.when(para == "", zero).otherwise(counted)

    return F.aggregate(F.split(c, "\n\n"), zero, of_paragraph)


def paragraphs(c: Column) -> Column:
    """The non-blank pieces between double newlines, as an array."""
    return F.filter(F.split(c, "\n\n"), lambda p: strip_space(p) != "")


def paragraph_count(c: Column) -> Column:
    return F.array_size(paragraphs(c)).cast("bigint")
