"""Choosing, renaming and rendering columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablelens.functions.numbers import percent_to_fraction


def quoted(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def _whole_number(text: str) -> int | None:
    return int(text) if text.isascii() and text.removeprefix("+").isdigit() else None


def parse_columns(spec: str) -> list[int] | list[str]:
    """A column spec: '0:3' (inclusive positions), '0,2,4' (positions) or 'name,age'."""
    spec = spec.strip()
    if not spec:
        raise ValueError("column selection is empty")
    ends = [_whole_number(part) for part in spec.split(":")]
    if len(ends) == 2 and None not in ends:
        start, end = ends
        if start > end:
            raise ValueError(f"column range starts at {start}, after its end {end}")
        return list(range(start, end + 1))
    parts = [part.strip() for part in spec.split(",") if part.strip()]
    if not parts:
        raise ValueError(f"not a column selection: {spec!r}")
    positions = [_whole_number(part) for part in parts]
    return parts if None in positions else positions


def select_columns(df: DataFrame, spec: str | None) -> DataFrame:
    """Project to the columns a spec names; None keeps all."""
    if spec is None:
        return df
    places = []
    for want in parse_columns(spec):
        if isinstance(want, str) and want not in df.columns:
            raise ValueError(f"no column named {want!r}")
        if isinstance(want, int) and want >= len(df.columns):
            raise ValueError(f"column position {want} is out of range, there are {len(df.columns)}")
        places.append(df.columns.index(want) if isinstance(want, str) else want)
    # By place, as names that differ only in case cannot be told apart.
    marked = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return marked.select(*[f"c{i}" for i in places]).toDF(*[df.columns[i] for i in places])


def free_name(name: str, taken: list[str]) -> str:
    """`name`, with underscores added until no column has it."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


def number_columns(df: DataFrame) -> DataFrame:
    """Replace the column names by their 0-based positions."""
    return df.toDF(*[str(i) for i in range(len(df.columns))])


def cell_text(df: DataFrame, name: str) -> Column:
    """One cell as text; nested values as JSON, null as 'null'."""
    nested = isinstance(df.schema[name].dataType, (T.ArrayType, T.MapType, T.StructType))
    c = quoted(name)
    return F.coalesce(F.to_json(c) if nested else c.cast("string"), F.lit("null"))


def truncate(c: Column, width: int) -> Column:
    """Longer text keeps its first width-3 characters and gets '...'."""
    return F.when(F.char_length(c) > width, F.concat(F.substring(c, 1, width - 3), F.lit("..."))).otherwise(c)


def truncate_cells(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every column as text cut to max(10, length of its name) characters; `keep` untouched."""
    return df.select(
        *[
            quoted(n) if n in keep else truncate(cell_text(df, n), max(10, len(n))).alias(n)
            for n in df.columns
        ]
    )


def render_tsv(df: DataFrame, name: str = "line") -> Column:
    """A row as tab-separated text."""
    return F.concat_ws("\t", *[cell_text(df, n) for n in df.columns]).alias(name)


def tsv_header(df: DataFrame) -> str:
    return "\t".join(df.columns)


def normalise_percent(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Turn string columns whose every non-empty value ends in '%' into fractions.

    One aggregate decides, one row per column reaches the driver; the conversion is lazy.
    """
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    names = [n for n in (names or texts) if n in texts]
    if not names:
        return df
    c = F.col("c")
    cells = F.array(*[F.struct(F.lit(i).alias("idx"), quoted(n).alias("c")) for i, n in enumerate(names)])
    found = (
        df.select(F.inline(cells))
        .where(c != "")
        .groupBy("idx")
        .agg(F.bool_and(c.endswith("%")).alias("percent"))
        .where("percent")
        .collect()  # at most one row per column
    )
    chosen = {names[r.idx] for r in found}
    return df.select(
        *[percent_to_fraction(quoted(n)).alias(n) if n in chosen else quoted(n) for n in df.columns]
    )
