"""URL filter by a path-template tree, in DataFrame functions only.

Per host every path becomes a template: segments that are numbers, dates, hexadecimal or otherwise
mostly digits turn into ``*``, file endings are kept apart. Siblings, however few, whose labelled
shares do not differ are variable too and are merged into ``*``. A child differs from its siblings
where a two-proportion test, with one good and one bad page added on each side, exceeds `differs`
standard errors. Children below their siblings are compared among themselves in the same way, and
so are those above: what merges there is ``*#-``, ``*#+`` and so on. Templates are judged by their labelled share of good pages, smoothed
towards the host's share and that towards the share of all labels; below `reject` they are blocked.

Explicit rules come first: a rule names a host and a path prefix, fits that host and its subdomains,
and the longest rule that fits decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import kept

#: Segments that look generated: digits, hexadecimal of 8 or more, dates, or more than half digits.
VARIABLE = r"^(?:\d+|[0-9a-fA-F]{8,}|\d{4}-\d{2}(?:-\d{2})?)$"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; otherwise empty."""
    host = F.regexp_extract(_after(url), r"(?s)^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(F.coalesce(at, F.lit(0)) > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def segments_of(path: Column) -> Column:
    """The path's segments, generated ones as ``*``; a file ending stays: ``*.html``."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")

    def one(s: Column) -> Column:
        stem, ending = F.regexp_replace(s, r"\.[A-Za-z]{1,5}$", ""), F.regexp_extract(s, r"(\.[A-Za-z]{1,5})$", 1)
        digits = F.length(F.regexp_replace(stem, r"[^0-9]", ""))
        return F.when(stem.rlike(VARIABLE) | (digits * 2 > F.length(stem)), F.concat(F.lit("*"), ending)).otherwise(s)

    return F.transform(parts, one)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest (host, path prefix, verdict) rule that fits; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for name, prefix, decision in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        rule = F.when(fits, F.lit(name + prefix)).otherwise(rule)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def templates(pages: DataFrame, depth: int = 6, differs: float = 1.96) -> DataFrame:
    """The merged tree's leaves: (host, raw, template, n, labelled, good).

    `pages` has (host, segments, good), good being null without a label. Beyond `depth` segments
    a path counts by its first ones with ``**`` behind them. Level by level: children of one parent
    template are merged when they are similar.
    """
    shaped = pages.select(
        "host",
        F.when(F.size("segments") > depth, F.concat(F.slice("segments", 1, depth), F.array(F.lit("**")))).otherwise(F.col("segments")).alias("raw"),
        F.col("good").cast("double").alias("good"),
    )
    leaves = shaped.groupBy("host", "raw").agg(F.count("*").alias("n"), F.count("good").alias("labelled"), F.coalesce(F.sum("good"), F.lit(0.0)).alias("good"))
    leaves = kept(leaves.withColumn("template", F.col("raw")), "templates")
    deepest = leaves.agg(F.coalesce(F.max(F.size("raw")), F.lit(0))).first()[0]
    for level in range(1, min(depth, deepest) + 1):
        parent = F.slice("template", 1, level - 1)
        child = F.get("template", F.lit(level - 1))
        at = leaves.where(F.size("template") >= level)
        by_child = at.groupBy("host", parent.alias("parent"), child.alias("child")).agg(
            F.sum("labelled").alias("c_labelled"), F.sum("good").alias("c_good")
        )
        merged = _merged(by_child, differs)
        key = leaves.withColumn("parent", parent).withColumn("child", child)
        leaves = key.join(merged, ["host", "parent", "child"], "left").select(  # one row per leaf
            "host",
            "raw",
            F.when(
                F.col("name").isNotNull(),
                F.concat(F.col("parent"), F.array(F.col("name")), F.slice("template", level + 1, depth + 1)),
            ).otherwise(F.col("template")).alias("template"),
            "n",
            "labelled",
            "good",
        )
        leaves = kept(leaves, "templates")
    return leaves


def _merged(by_child: DataFrame, differs: float) -> DataFrame:
    """(host, parent, child, name) of the children that are merged under a name; `by_child` has (host, parent, child, c_labelled, c_good).

    Of a group the best child never differs downwards nor the worst upwards, so groups shrink until
    nothing differs.
    """
    open_, settled = kept(by_child.withColumn("part", F.lit("")), "children"), None
    group = ["host", "parent", "part"]
    while True:
        pool = open_.groupBy(*group).agg(F.sum("c_labelled").alias("p_labelled"), F.sum("c_good").alias("p_good"))
        n, m = F.col("c_labelled") + 2.0, F.col("p_labelled") - F.col("c_labelled") + 2.0
        one, rest = (F.col("c_good") + 1.0) / n, (F.col("p_good") - F.col("c_good") + 1.0) / m
        z = (one - rest) / F.sqrt(one * (1.0 - one) / n + rest * (1.0 - rest) / m)
        side = F.when(z > differs, F.lit("+")).when(z < -differs, F.lit("-")).otherwise(F.lit(""))
        now = kept(open_.join(pool, group).select(*open_.columns, side.alias("side")), "siblings")
        alike = now.where("side = ''").drop("side")
        settled = alike if settled is None else settled.union(alike)
        open_ = now.where("side <> ''").withColumn("part", F.concat("part", "side")).drop("side")
        if open_.isEmpty():
            break
    settled = kept(settled, "merged")
    sizes = settled.groupBy(*group).agg(F.count("*").alias("size"))
    name = F.when(F.col("part") == "", F.lit("*")).otherwise(F.concat(F.lit("*#"), F.col("part")))  # no segment holds a #
    return settled.join(sizes, group).where("size > 1 or child = '*'").select("host", "parent", "child", name.alias("name"))


def judge_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules: list[tuple[str, str, str]],
    reject: float = 0.5,
    pseudo: float = 10.0,
    depth: int = 6,
    differs: float = 1.96,
    id_col: str = "page_id",
    url_col: str = "url",
    label_id: str = "doc_id",
    label_col: str = "quality",
) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity): one row per page.

    Labels are joined on the page's id; several labels of one id are averaged, null labels count
    as none. A null URL or one without ``://`` has empty host and path and is judged with its like.
    Repeated rows are judged alike; without labels every template has purity 0.5 and passes.
    """
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url")).select(
        "page_id", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.coalesce(path_of(F.col("url")), F.lit("")).alias("path")
    )
    base = base.withColumn("segments", segments_of(F.col("path")))
    truth = (
        labels.select(F.col(label_id).cast("long").alias("page_id"), F.col(label_col).cast("double").alias("good"))
        .where("page_id is not null and good is not null")
        .groupBy("page_id")
        .agg(F.avg("good").alias("good"))
    )
    leaves = templates(base.join(truth, "page_id", "left"), depth, differs)
    by_template = leaves.groupBy("host", "template").agg(F.sum("labelled").alias("t_n"), F.sum("good").alias("t_good"))
    by_host = by_template.groupBy("host").agg(F.sum("t_n").alias("h_n"), F.sum("t_good").alias("h_good"))
    share = truth.agg(F.coalesce((F.sum("good") + 1.0) / (F.count("good") + 2.0), F.lit(0.5))).first()[0]
    host_rate = (F.col("h_good") + pseudo * share) / (F.col("h_n") + pseudo)
    purity = (F.col("t_good") + pseudo * host_rate) / (F.col("t_n") + pseudo)
    rated = by_template.join(by_host, "host").select("host", "template", purity.alias("purity"))
    verdicts = leaves.select("host", "raw", "template").join(rated, ["host", "template"])
    raw = F.when(F.size("segments") > depth, F.concat(F.slice("segments", 1, depth), F.array(F.lit("**")))).otherwise(F.col("segments"))
    rule, decision = rule_for(F.col("host"), F.col("path"), rules)
    return (
        base.withColumn("raw", raw)
        .join(verdicts, ["host", "raw"])
        .select(
            "page_id",
            "host",
            "path",
            rule.alias("rule"),
            F.coalesce(decision, F.when(F.col("purity") < reject, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
            F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"),
            "purity",
        )
    )
