"""Format-preserving Feistel pseudonyms for personal data, in DataFrame functions only.

Card numbers, phone numbers, social security numbers, IPv4 addresses, dates and e-mail addresses
are found by one pattern, validated, and replaced by the image of a keyed permutation on the set
of all values of the same format: a Feistel network whose two halves count modulo A and modulo B,
on a set of A * B values. Equal values get equal pseudonyms in every document, different values
different ones, and a pseudonym is valid in its format (check digit, calendar, octets).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
_YMD = r"\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{4}\.\d{1,2}\.\d{1,2}"
_DMY = r"\d{1,2}-\d{1,2}-\d{4}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}"
_SSN = r"\d{3}-\d{2}-\d{4}"
_PHONE = r"(?:\+?\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}"
_IP = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
#: Ten digits without separators, where area code and exchange begin with 2-9.
_BARE_PHONE = r"(?:\+?1)?[2-9]\d{2}[2-9]\d{6}"
_SINGLE = [_YMD, _DMY, _SSN, _PHONE, _IP]
#: Groups of digits, a space or hyphen between them, thirteen digits at least; a group that begins a date or address is not taken in.
_GROUP = r"(?!(?:\d{1,2}[./]\d{1,2}[./]\d{4}|\d{4}[./]\d{1,2}[./]\d{1,2}|" + _IP + r")(?![A-Za-z0-9]))\d++(?![A-Za-z0-9])"
_RUN = r"(?=\d(?:[ -]?\d){12})" + _GROUP + r"(?:[ -]" + _GROUP + r")*+"
#: Digits of card numbers.
CARD_DIGITS = (13, 19)


def _pattern(numbers: list[str]) -> str:
    return EMAIL + r"|(?<![A-Za-z0-9])(?:" + "|".join(numbers) + r")(?![A-Za-z0-9])"


PATTERN, IN_RUN = _pattern([*_SINGLE, _RUN, _BARE_PHONE]), _pattern([*_SINGLE, _BARE_PHONE])
#: Days are permuted within blocks of this many, counted from this day; three blocks reach from 1703 to 2294.
DAY_BLOCK, DAY_ZERO = (240, 300), "1900-03-01"

def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _whole(c: Column) -> Column:
    return c.cast("long")


def _round(key: str, tag: Column, k: Column, x: Column) -> Column:
    """The round function: 60 bits of a keyed SHA-256."""
    text = F.concat_ws("|", F.lit(key), tag, k.cast("string"), x.cast("string"))
    return _whole(F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10))


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, tag: Column) -> Column:
    """(l, r): a keyed permutation of the pairs with l below a and r below b."""
    start = F.struct(_whole(left).alias("l"), _whole(right).alias("r"))

    def step(s: Column, k: Column) -> Column:
        new_l = _whole(F.pmod(s["l"] + F.pmod(_round(key, tag, k, s["r"]), a), a))
        new_r = _whole(F.pmod(s["r"] + F.pmod(_round(key, tag, k, s["l"]), b), b))
        even = k % 2 == 0
        return F.struct(F.when(even, new_l).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(new_r).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def refill(m: Column, digits: Column) -> Column:
    """`m` with its digits replaced, in order, by `digits`."""

    def one(i: Column) -> Column:
        c = F.substring(m, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), F.substring(digits, F.length(digits_of(F.substring(m, F.lit(1), i))), F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), one), "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a number whose check digit stands last."""
    n = F.length(digits)

    def add(s: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return s + F.when((n - i) % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _int(c: Column, start: int | Column, length: int | Column) -> Column:
    at = F.lit(start) if isinstance(start, int) else start
    return _whole(F.substring(c, at, F.lit(length) if isinstance(length, int) else length))


def _padded(c: Column, n: int | Column) -> Column:
    """`c` with leading zeros to n digits."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.concat(F.repeat(F.lit("0"), n - F.length(c.cast("string"))), c.cast("string"))


def card(m: Column, key: str) -> Column:
    """The first digit stays, the check digit is made anew, the digits between are permuted."""
    power = lambda n: _whole(F.pow(F.lit(10.0), n))

    def made(d: Column) -> Column:
        middle = F.length(d) - 2
        half = F.floor(middle / 2).cast("int")
        rest = middle - half
        out = feistel(_int(d, 2, half), _int(d, half + 2, rest), power(half), power(rest), key, F.concat(F.lit("card"), F.length(d).cast("string")))
        body = let(out, lambda o: F.concat(F.substring(d, F.lit(1), F.lit(1)), _padded(o["l"], half), _padded(o["r"], rest)))
        whole = let(body, lambda x: F.concat(x, F.pmod(10 - F.pmod(luhn_sum(F.concat(x, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")))
        return F.when(F.pmod(luhn_sum(d), F.lit(10)) == 0, let(whole, lambda x: refill(m, x))).otherwise(m)

    return let(digits_of(m), made)


def phone(m: Column, key: str) -> Column:
    """The last ten digits are permuted; area code and exchange begin with 2-9 as before, or with 0-1 as before."""

    def made(d: Column) -> Column:
        lead = F.substring(d, F.lit(1), F.length(d) - 10)
        area, rest = _int(d, F.length(d) - 9, 3), _int(d, F.length(d) - 6, 7)
        low_a, low_r = F.when(area >= 200, 200).otherwise(0), F.when(rest >= 2_000_000, 2_000_000).otherwise(0)
        size_a, size_r = F.when(area >= 200, 800).otherwise(200), F.when(rest >= 2_000_000, 8_000_000).otherwise(2_000_000)
        out = feistel(area - low_a, rest - low_r, size_a, size_r, key, F.concat_ws("-", F.lit("phone"), low_a.cast("string"), low_r.cast("string")))
        return let(let(out, lambda o: F.concat(lead, _padded(o["l"] + low_a, 3), _padded(o["r"] + low_r, 7))), lambda x: refill(m, x))

    return let(digits_of(m), made)


def ssn(m: Column, key: str) -> Column:
    """Area 001-899 without 666, group 01-99, serial 0001-9999; other numbers are no valid ones and stay."""
    area, group, serial = _int(m, 1, 3), _int(m, 5, 2), _int(m, 8, 4)
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = F.when(area > 666, area - 2).otherwise(area - 1)
    out = feistel(place, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, F.lit("ssn"))

    def shown(o: Column) -> Column:
        new = F.when(o["l"] >= 665, o["l"] + 2).otherwise(o["l"] + 1)
        return F.concat_ws("-", _padded(new, 3), _padded(_whole(F.floor(o["r"] / 9999)) + 1, 2), _padded(F.pmod(o["r"], F.lit(9999)) + 1, 4))

    return F.when(valid, let(out, shown)).otherwise(m)


def address(m: Column, key: str) -> Column:
    """IPv4: four octets up to 255; anything else stays."""
    high, low = lambda x: _whole(F.floor(x / 256)), lambda x: F.pmod(x, F.lit(256))

    def made(o: Column) -> Column:
        at = lambda i: F.get(o, F.lit(i))
        out = feistel(at(0) * 256 + at(1), at(2) * 256 + at(3), F.lit(65536), F.lit(65536), key, F.lit("ip"))
        shown = lambda x: F.concat_ws(".", *(c.cast("string") for c in (high(x["l"]), low(x["l"]), high(x["r"]), low(x["r"]))))
        return F.when(F.forall(o, lambda x: x <= 255), let(out, shown)).otherwise(m)

    return let(F.transform(F.split(m, r"\."), lambda x: x.cast("long")), made)


def date(m: Column, key: str) -> Column:
    """Calendar days from 1703 to 2294; the order of fields, separators and leading zeros stay.

    Year last: with slashes the month comes first, otherwise the day, unless only the other order
    is a day of the calendar. Equal days in different notations get the same pseudonym.
    """
    sep = F.regexp_extract(m, r"([-/.])", 1)
    day_of = lambda y, mo, d: F.try_to_date(F.concat_ws("-", y, F.lpad(mo, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    zero, (wide, deep) = F.lit(DAY_ZERO).cast("date"), DAY_BLOCK
    size = wide * deep

    def moved(n: Column) -> Column:
        block = F.floor(n / size)
        at = F.pmod(n, F.lit(size))
        out = feistel(F.floor(at / deep), F.pmod(at, F.lit(deep)), F.lit(wide), F.lit(deep), key, F.concat(F.lit("date"), block.cast("string")))
        return F.when(block.between(-1, 1), let(out, lambda o: F.date_add(zero, (block * size + o["l"] * deep + o["r"]).cast("int"))))

    def made(parts: Column) -> Column:
        p0, p1, p2 = (F.get(parts, F.lit(i)) for i in range(3))
        narrow = F.exists(parts, lambda x: F.length(x) == 1)
        # the order of fields that names a day
        choice = let(
            F.struct(day_of(p0, p1, p2).alias("ymd"), day_of(p2, p0, p1).alias("mdy"), day_of(p2, p1, p0).alias("dmy")),
            lambda d: F.when(F.length(p0) == 4, F.struct(F.lit("ymd").alias("order"), d["ymd"].alias("day")))
            .when(F.when(sep == "/", d["mdy"].isNotNull()).otherwise(d["dmy"].isNull()), F.struct(F.lit("mdy").alias("order"), d["mdy"].alias("day")))
            .otherwise(F.struct(F.lit("dmy").alias("order"), d["dmy"].alias("day"))),
        )

        def shown(order: Column, day: Column) -> Column:
            two = lambda x: F.when(narrow, x.cast("string")).otherwise(F.lpad(x.cast("string"), 2, "0"))
            y, mo, d = F.lpad(F.year(day).cast("string"), 4, "0"), two(F.month(day)), two(F.dayofmonth(day))
            return (
                F.when(order == "ymd", F.concat(y, sep, mo, sep, d)).when(order == "mdy", F.concat(mo, sep, d, sep, y)).otherwise(F.concat(d, sep, mo, sep, y))
            )

        return let(choice, lambda c: let(let(F.datediff(c["day"], zero), moved), lambda day: shown(c["order"], day)))

    return F.coalesce(let(F.split(m, r"[-/.]"), made), m)


def email(m: Column, key: str) -> Column:
    """The part before the @ is permuted character by character within letters of its case and digits; the domain stays.

    A Feistel network on the characters: each half is shifted by amounts that hang on the other.
    """
    local, domain = F.substring_index(m, "@", 1), F.concat(F.lit("@"), F.substring_index(m, "@", -1))
    half = F.floor((F.length(local) + 1) / 2).cast("int")

    def shifted(s: Column, k: Column, other: Column) -> Column:
        def one(i: Column) -> Column:
            c = F.substring(s, i, F.lit(1))
            code = F.ascii(c)
            by = _round(key, F.concat_ws(":", F.lit("mail"), F.length(local).cast("string"), i.cast("string")), k, other)
            turned = lambda low, n: F.chr(low + F.pmod(code - low + F.pmod(by, F.lit(n)), F.lit(n)))
            return (
                F.when(code.between(48, 57), turned(48, 10)).when(code.between(65, 90), turned(65, 26)).when(code.between(97, 122), turned(97, 26)).otherwise(c)
            )

        return F.when(F.length(s) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(s)), one), "")).otherwise(s)

    def step(s: Column, k: Column) -> Column:
        even = k % 2 == 0
        return F.struct(
            F.when(even, shifted(s["l"], k, s["r"])).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise(shifted(s["r"], k, s["l"])).alias("r"),
        )

    start = F.struct(F.substring(local, F.lit(1), half).alias("l"), F.substring(local, half + 1, F.length(local)).alias("r"))
    out = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)
    return let(out, lambda o: F.concat(o["l"], o["r"], domain))


def _is(m: Column, pattern: str) -> Column:
    return m.rlike("^(?:" + pattern + ")$")


def _single(m: Column, key: str, other: Column) -> Column:
    """The pseudonym of a value that stands for itself; `other` for any other match."""
    return (
        F.when(F.contains(m, F.lit("@")), email(m, key))
        .when(_is(m, _YMD) | _is(m, _DMY), date(m, key))
        .when(_is(m, _SSN), ssn(m, key))
        .when(_is(m, _IP), address(m, key))
        .when(_is(m, _PHONE) | _is(m, _BARE_PHONE), phone(m, key))
        .otherwise(other)
    )


def _replaced(text: Column, pattern: str, one: Callable[[Column], Column]) -> Column:
    """`text` with `one` of each match in its place."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    names = F.concat(F.transform(found, one), F.array(F.lit("")))
    return F.array_join(F.zip_with(F.split(text, pattern, -1), names, lambda a, b: F.concat(a, b)), "")


def cards_in(groups: Column) -> Column:
    """(first, last) of the valid card numbers among groups of digits, as whole groups counted from 1.

    From left to right; where several begin at a group, the longest. No two share a group.
    """
    n = F.size(groups)

    def valid(i: Column, j: Column) -> Column:
        joined = F.array_join(F.slice(groups, i, j - i + 1), "")
        return let(joined, lambda d: F.when(F.length(d).between(*CARD_DIGITS), F.pmod(luhn_sum(d), F.lit(10)) == 0).otherwise(False))

    def longest(i: Column) -> Column:
        ends = F.sequence(F.least(i + CARD_DIGITS[1] - 1, n), i, F.lit(-1))
        return F.struct(i.alias("first"), F.get(F.filter(ends, lambda j: valid(i, j)), F.lit(0)).alias("last"))

    every = F.filter(F.transform(F.sequence(F.lit(1), n), longest), lambda x: x["last"].isNotNull())
    start = F.lit(None).cast("struct<last:int,cards:array<struct<first:int,last:int>>>")
    start = F.coalesce(start, F.struct(F.lit(0).alias("last"), F.array().cast("array<struct<first:int,last:int>>").alias("cards")))

    def take(s: Column, x: Column) -> Column:
        with_x = F.struct(x["last"].alias("last"), F.concat(s["cards"], F.array(x)).alias("cards"))
        return F.when(x["first"] > s["last"], with_x).otherwise(s)

    return F.aggregate(every, start, take, lambda s: s["cards"])


def cards(run: Column, key: str) -> Column:
    """A run of groups of digits with its valid card numbers, and values of other kinds between them, replaced."""

    def made(groups: Column, marks: Column, found: Column) -> Column:
        def shown(first: Column, length: Column) -> Column:
            """Groups, each with the mark behind it."""
            both = F.zip_with(F.slice(groups, first, length), F.slice(marks, first, length), lambda g, c: F.concat(g, F.coalesce(c, F.lit(""))))
            return F.array_join(both, "")

        def piece(k: Column) -> Column:
            behind = F.coalesce(F.get(found, k - 1)["last"], F.lit(0)) + 1
            at = F.get(found, k)
            rest = shown(behind, F.coalesce(at["first"], F.size(groups) + 1) - behind)
            number = let(shown(at["first"], at["last"] - at["first"] + 1), lambda c: F.concat(card(F.rtrim(F.rtrim(c), F.lit("-")), key), F.regexp_extract(c, "[ -]?$", 0)))
            other = let(rest, lambda r: F.when(r.rlike("[0-9]{2}"), _replaced(r, IN_RUN, lambda m: _single(m, key, m))).otherwise(r))
            return F.concat(other, F.when(at.isNotNull(), number).otherwise(F.lit("")))

        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(found)), piece), "")

    parts = F.struct(F.split(run, "[ -]").alias("groups"), F.regexp_extract_all(run, F.lit("[ -]"), F.lit(0)).alias("marks"))
    return let(parts, lambda p: let(cards_in(p["groups"]), lambda found: made(p["groups"], p["marks"], found)))


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one match of PATTERN; what is no valid value stays as it is."""
    return _single(m, key, cards(m, key))


def pseudonymized(text: Column, key: str) -> Column:
    """The text with all pseudonyms in place; a null text stays null."""
    return F.when(text.rlike("[0-9@]"), _replaced(text, PATTERN, lambda m: pseudonym(m, key))).otherwise(text)


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """`docs` with `text_col` replaced; all rows and all other columns stay as they are.

    Null and empty texts stay; repeated rows stay repeated; an empty table stays empty. Long texts
    are handled whole. A card number is any row of whole groups of digits (spaces or hyphens between
    them) of 13 to 19 digits with a valid check digit, whatever digits stand before or behind it; the
    longest where several begin at a group. What begins like a date, SSN or phone is read as that.
    """
    out = pseudonymized(F.col(f"`{text_col}`").cast("string"), key)
    return docs.withColumn(text_col, out)
