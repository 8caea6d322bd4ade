"""Quality: hierarchical empirical Bayes over documents, hosts and paths.

A document's own evidence is a naive Bayes log-likelihood ratio over binned shape features (share
of symbols, distinct words, word length, length, sentence ends). Hosts and the paths below them
have posterior rates of good documents: a host's rate is shrunk towards the global rate, a path's
towards its host's, each with a prior strength that is estimated from how much the groups differ
beyond chance (moments of the beta-binomial). A path with few labels thus lies near its host, a host
with few near the global rate. The document's posterior is its path's rate, as prior odds, times its
evidence. Everything is a grouped aggregation; what reaches the driver is one row per feature bin.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import kept

#: Bins of every feature, 0 to BINS - 1.
BINS = 16


def _binned(x: Column) -> Column:
    return F.least(F.greatest(F.floor(x), F.lit(0)), F.lit(BINS - 1)).cast("int")


def shape_features(text: Column) -> dict[str, Column]:
    """Binned features of a text; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, size = F.greatest(F.size(words), F.lit(1)), F.greatest(F.length(text), F.lit(1))
    symbols = F.regexp_count(text, F.lit(r"[|&%$#*=<>{}~^_@\\\[\]]"))
    ends = F.regexp_count(text, F.lit(r"[.!?]"))
    return {
        "symbols": _binned(F.when(symbols == 0, 0).otherwise(8 + F.log2(symbols / size) / 2 + 4)),
        "distinct": _binned(F.size(F.array_distinct(words)) / n * 15.99),
        "word_length": _binned(size / n),
        "words": _binned(F.log2(n)),
        "ends": _binned(F.when(ends == 0, 0).otherwise(8 + F.log2(ends / n))),
    }


def strength(groups: DataFrame, rate: Column, good: str, n: str) -> float:
    """Prior strength from the spread of group rates around `rate`, by the moments of the beta-binomial."""
    p = F.col(good) / F.col(n)
    row = groups.where(F.col(n) > 0).agg(
        F.sum(F.col(n) * (p - rate) * (p - rate)).alias("s"), F.sum(rate * (1 - rate)).alias("v"), F.sum(F.col(n) * rate * (1 - rate)).alias("nv"),
        F.sum(n).alias("n"), F.sum(F.col(n) * F.col(n)).alias("nn"), F.count("*").alias("g"),
    ).first()
    if not row["g"] or row["g"] < 2 or not row["nv"]:
        return 10.0
    average = row["nv"] / row["n"]
    rho = (row["s"] - row["v"]) / max(average * (row["n"] - row["nn"] / row["n"]), 1e-12)
    rho = min(max(rho, 1e-4), 0.5)
    return 1 / rho - 1


def judge(
    docs: DataFrame, labels: DataFrame, host_col: str, path_col: str, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, evidence, host_rate, path_rate, score, keep): one row per row.

    `labels` has (doc_id, quality); rows with nulls are left out, several labels of an id are
    averaged and rounded. A null text counts as empty, null hosts and paths are groups of their own
    and a null id matches no label. Repeated rows are judged alike. Without labels of both kinds
    evidence is 0 and all rates are the smoothed global rate.
    """
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text")
    )
    features = shape_features(F.col("text"))
    base = kept(base.select("doc_id", "host", "path", *(c.alias("f_" + k) for k, c in features.items())), "features")
    truth = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("q"))
        .where("doc_id is not null and q is not null")
        .groupBy("doc_id")
        .agg((F.avg("q") >= 0.5).cast("int").alias("good"))
    )
    known = base.join(truth, "doc_id")
    # one row per feature, bin and class
    entries = F.explode(F.array(*(F.struct(F.lit(k).alias("feature"), F.col("f_" + k).alias("bin")) for k in features)))
    counts = {(r.feature, r.bin): (r.good, r.n - r.good) for r in known.select(entries.alias("e"), "good").groupBy("e.feature", "e.bin").agg(F.sum("good").alias("good"), F.count("*").alias("n")).collect()}
    evidence = F.lit(0.0)
    for k in features:
        mine = {b: c for (f, b), c in counts.items() if f == k}
        good, bad = sum(g for g, _ in mine.values()), sum(b for _, b in mine.values())
        if good and bad:
            ratios = [math.log((mine.get(b, (0, 0))[0] + 0.5) / (good + 0.5 * BINS) / ((mine.get(b, (0, 0))[1] + 0.5) / (bad + 0.5 * BINS))) for b in range(BINS)]
            evidence = evidence + F.element_at(F.array(*map(F.lit, ratios)), F.col("f_" + k) + 1)
    # rates: path within host within all
    paths = kept(
        base.join(truth, "doc_id", "left").groupBy("host", "path").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("k")), "paths"
    )
    hosts = paths.groupBy("host").agg(F.sum("n").alias("h_n"), F.sum("k").alias("h_k"))
    total = hosts.agg(F.coalesce(F.sum("h_n"), F.lit(0)).alias("n"), F.coalesce(F.sum("h_k"), F.lit(0)).alias("k")).first()
    overall = (total["k"] + 1.0) / (total["n"] + 2.0)
    of_hosts = strength(hosts, F.lit(overall), "h_k", "h_n")
    hosts = hosts.withColumn("host_rate", (F.col("h_k") + of_hosts * overall) / (F.col("h_n") + of_hosts)).select(F.col("host").alias("h"), "host_rate")
    rated = paths.join(hosts, F.col("host").eqNullSafe(F.col("h")))
    of_paths = strength(rated, F.col("host_rate"), "k", "n")
    rated = rated.select(
        F.col("host").alias("g_host"), F.col("path").alias("g_path"), "host_rate",
        ((F.col("k") + of_paths * F.col("host_rate")) / (F.col("n") + of_paths)).alias("path_rate"),
    )
    joined = base.join(rated, F.col("host").eqNullSafe(F.col("g_host")) & F.col("path").eqNullSafe(F.col("g_path")))
    odds = F.log(F.col("path_rate") / (1 - F.col("path_rate"))) + F.col("evidence")
    return (
        joined.withColumn("evidence", evidence)
        .withColumn("score", 1 / (1 + F.exp(-odds)))
        .select("doc_id", "evidence", "host_rate", "path_rate", "score", (F.col("score") >= threshold).alias("keep"))
    )
