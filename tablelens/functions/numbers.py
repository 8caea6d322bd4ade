"""Reading numbers out of text and writing them back as text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tablelens.functions.words import SPACE, strip_space

# A plain decimal literal. Java's parser would also take '1d', '1.5f' and hex floats,
# which are words to us, so every cast below is guarded by this pattern.
DECIMAL = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
NUMBER = rf"^{DECIMAL}\z"
PADDED_NUMBER = rf"^{SPACE}*{DECIMAL}{SPACE}*\z"
SPECIAL = r"^(?i)[+-]?(inf|infinity|nan)\z"


def is_finite(c: Column) -> Column:
    """True for a double that is not NaN or infinite; Spark orders NaN above infinity."""
    return F.abs(c) < F.lit(float("inf"))


def finite_or_null(c: Column) -> Column:
    return F.when(is_finite(c), c)


def parse_finite(c: Column) -> Column:
    """Trimmed text to a finite double; null when it is not one."""
    # Text that starts with an ASCII letter is no number; comparing one character is far
    # cheaper than a pattern. White space may be non-ASCII, so that part stays in.
    start = F.left(c, F.lit(1))
    number = (
        F.when((start > "9") & (start < "\x7f"), F.lit(None).cast("double"))
        .when(c.rlike(NUMBER), c.try_cast("double"))
        .when(c.rlike(PADDED_NUMBER), strip_space(c).try_cast("double"))
    )
    return finite_or_null(number)


def parse_any(c: Column) -> Column:
    """Untrimmed text to a double, with inf and nan accepted; null when it is not a number."""
    special = (
        F.when(F.lower(c).contains("nan"), F.lit(float("nan")))
        .when(c.startswith("-"), F.lit(float("-inf")))
        .otherwise(F.lit(float("inf")))
    )
    start = F.left(c, F.lit(1))
    return (
        F.when(start <= "9", F.when(c.rlike(NUMBER), c.try_cast("double")).when(c.rlike(SPECIAL), special))
        .when(F.lower(start).isin("i", "n"), F.when(c.rlike(SPECIAL), special))
    )


def render_double(c: Column) -> Column:
    """Text of a double in positional notation: 20.0 -> '20', 1.0E7 -> '10000000', infinity -> 'inf'.

    The digits are the JVM's; before Java 19 a few doubles show one digit too many.
    """
    s = c.cast("string")
    sign = F.regexp_extract(s, r"^(-?)", 1)
    whole = F.regexp_extract(s, r"^-?(\d+)", 1)
    frac = F.regexp_replace(F.regexp_extract(s, r"\.(\d+)", 1), "^0$", "")
    exp = F.regexp_extract(s, r"E(-?\d+)$", 1).try_cast("int")
    digits = F.concat(whole, frac)
    n_frac = F.char_length(frac)
    shifted_right = F.when(
        exp >= n_frac, F.concat(digits, F.repeat(F.lit("0"), exp - n_frac))
    ).otherwise(
        F.concat(whole, F.substring(frac, F.lit(1), exp), F.lit("."), F.substring(frac, exp + 1, n_frac))
    )
    shifted_left = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exp - 1), digits)
    positional = F.concat(sign, F.when(exp >= 0, shifted_right).otherwise(shifted_left))
    plain = F.replace(F.regexp_replace(s, r"\.0$", ""), F.lit("Infinity"), F.lit("inf"))
    return F.when(s.rlike(r"E-?\d+$"), positional).otherwise(plain)


def percent_to_fraction(c: Column) -> Column:
    """'12.5%' -> 0.125; text before the sign that does not parse gives null."""
    body = strip_space(F.regexp_replace(c, "%$", ""))
    return F.when(c.endswith("%"), F.when(body.rlike(NUMBER), body.try_cast("double")) / 100.0)


def clock_micros(c: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone.

    Taken from the calendar fields; a cast would go through the session's time zone, which
    may skip or repeat an hour.
    """
    seconds = F.unix_date(c.cast("date")).cast("bigint") * 86_400 + F.hour(c) * 3600 + F.minute(c) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("bigint")
