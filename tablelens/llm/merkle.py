"""A Merkle manifest of a data set by butterfly exchange.

Rows are leaves, ordered inside their group; every `fanout` consecutive nodes make one node of the next
level, the groups' roots likewise the root of all. Leaves lie in aligned partitions of fanout ** levels
consecutive leaves of a group. Each partition hashes its own subtree; then aligned groups of `fanout`
subtrees swap their roots round by round: a partition sends the root that it holds to its partners in
the other subtrees of the group, and every partition hashes the common ancestor itself. After the last
round each partition has the root and all siblings above its own subtree, without a pass downward.
Where a subtree is cut short by the end of its group, its partitions share the partners that miss theirs.

Defined results: null values are `-`; a null group comes first, null keys come first in their group, and
rows of equal key follow each other by leaf hash (equal rows are interchangeable). A row whose key is null
is never tampered with. An empty table has no rows. Only the named columns are read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelens.llm.common import kept

FANOUT = 8
#: Levels of the tree inside a partition: 4,096 leaves.
LEVELS = 4
#: Partners that one row of a message plan stands for.
STRETCH = 4096


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field_text(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def lowered_text(value: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def group_key(value: Column) -> Column:
    """A group's name that is never null and sorts like it, null first."""
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), value.cast("string")))


def _ordered(df: DataFrame, order: list[str], group: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(rows with `pos`, their 0-based place in their group; the groups with their size `n`); `part` ascends with the order.

    Rows are dealt by ranges of the whole key, so a group that holds a third of them is cut up; a count per
    partition and group is all that is summed up.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col(group), *[F.col(c) for c in order], F.col("row")]
    dealt = df.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("row")
    # Ids of a partition are consecutive, in the order of its rows.
    dealt = kept(dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("mid")), label)
    counts = dealt.groupBy("part", group).agg(F.min("mid").alias("first"), F.count(F.lit(1)).alias("rows"))
    until = Window.partitionBy(group).orderBy("part")  # one row per partition
    counts = kept(counts.select("part", group, "rows", (F.sum("rows").over(until) - F.col("rows") - F.col("first")).alias("shift")), label + "-counts")
    rows = dealt.join(counts.drop("rows"), ["part", group]).withColumn("pos", F.col("mid") + F.col("shift")).drop("mid", "shift")
    return rows, counts.groupBy(group).agg(F.sum("rows").alias("n"))


def _groups(sizes: DataFrame, size: int) -> DataFrame:
    """(grp, n, blocks, gid, base): each group's place in the order of groups and the partitions of those before it."""
    sizes = sizes.withColumn("blocks", F.ceil(F.col("n") / size)).withColumn("all", F.lit(0))
    placed, _ = _ordered(sizes, ["grp"], "all", "groups")
    before = placed.groupBy("part").agg(F.sum("blocks").alias("here"))
    before = before.select("part", (F.sum("here").over(Window.orderBy("part")) - F.col("here")).alias("ahead"))  # one row per partition
    until = Window.partitionBy("part").orderBy("pos")
    base = F.col("ahead") + F.sum("blocks").over(until) - F.col("blocks")
    return placed.join(before, "part").select("grp", "n", "blocks", F.col("pos").alias("gid"), base.alias("base"))


def _node(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _subtree(leaves: list[str], n: int, fanout: int, levels: int) -> list[list[str]]:
    """The levels of a partition's subtree, leaves first; all of them where its group of `n` leaves has other partitions."""
    out = [leaves]
    while len(out) <= levels and (n > fanout**levels or len(out[-1]) > 1):
        low = out[-1]
        out.append([_node(low[i : i + fanout]) for i in range(0, len(low), fanout)])
    return out


def _partition_root(pdf, fanout: int, levels: int):
    """(grp, block, node): the root of one partition's subtree."""
    tree = _subtree(pdf.sort_values("pos")["leaf"].tolist(), pdf["n"].iloc[0], fanout, levels)
    return pdf[["grp", "block"]].iloc[:1].assign(node=tree[-1][0])


def _leaf_proofs(leaves, upper, fanout: int, levels: int):
    """The rows of one partition, from its leaves and the siblings that the rounds brought it."""
    import pandas as pd

    leaves = leaves.sort_values("pos")
    top = upper.iloc[0]
    tree = _subtree(leaves["leaf"].tolist(), leaves["n"].iloc[0], fanout, levels)
    above = [(int(r["digit"]), r["siblings"]) for r in top["up"]]
    proofs, folds = [], []
    for i, node in enumerate(leaves["tampered"].tolist()):
        siblings = []
        for level in tree[:-1]:
            run = level[i // fanout * fanout : (i // fanout + 1) * fanout]
            at = i % fanout
            siblings += run[:at] + run[at + 1 :]
            node = _node([*run[:at], node, *run[at + 1 :]])
            i //= fanout
        for digit, others in above:
            siblings.append(others)
            node = _node([others[: 64 * digit], node, others[64 * digit :]])
        proofs.append(_node(siblings))
        folds.append(node)
    return pd.DataFrame(
        {
            "doc_id": leaves["doc_id"],
            "leaf": leaves["leaf"],
            "subroot": top["subroot"],
            "root": top["root"],
            "proof_sha256": proofs,
            "folded_root": folds,
            "verified": [f == top["root"] for f in folds],
        }
    )


def _exchange(held: DataFrame, group: Column, digit: Column, active: Column) -> DataFrame:
    """One round. `group`: array<struct<start, size>> of the aligned subtrees that swap, `digit`: which of them is one's own.

    Partitions carry consecutive numbers `at`. A partition sends to the one at its own place in each other subtree;
    those whose partner's subtree is shorter are served by the partition at their place modulo its length.
    A receiver sends its own state to itself. Messages are grouped by receiver, at most one of each subtree.
    """
    alone = F.array(F.struct(F.col("at").alias("start"), F.lit(1).cast("long").alias("size")))
    sent = held.select(
        "*", F.when(active, group).otherwise(alone).alias("group"), F.when(active, digit).otherwise(0).cast("int").alias("digit"), active.alias("active")
    )
    own = F.get("group", F.col("digit"))
    sent = sent.select("*", (F.col("at") - own["start"]).alias("low"), own["size"].alias("own"), F.explode("group").alias("to"))
    # Receivers in that subtree: low, low + own, low + 2 * own, ... below its size. Long lists go in stretches.
    many = F.floor((F.col("to.size") - 1 - F.col("low")) / F.col("own")) + 1
    many = F.when(F.col("to.start") == F.col("at") - F.col("low"), 1).when(F.col("low") < F.col("to.size"), many).otherwise(0)
    sent = sent.withColumn("many", many.cast("long")).where("many > 0")
    sent = sent.withColumn("stretch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("many") - 1) / STRETCH))))
    first = F.col("stretch") * STRETCH
    sent = sent.withColumn("nth", F.explode(F.sequence(first, F.least(first + STRETCH, F.col("many")) - 1)))
    sent = sent.withColumn("receiver", F.col("to.start") + F.col("low") + F.col("nth") * F.col("own"))
    state = F.struct(*[c for c in held.columns if c not in ("at", "node")], "digit", "active")
    got = (
        sent.groupBy("receiver")
        .agg(
            F.sort_array(F.collect_list(F.struct("digit", "node"))).alias("messages"),
            F.any_value(F.when(F.col("receiver") == F.col("at"), state), True).alias("state"),
        )
    )
    active, own = F.col("state.active"), F.col("state.digit")
    nodes = F.transform("messages", lambda m: m["node"])
    others = F.transform(F.filter("messages", lambda m: m["digit"] != own), lambda m: m["node"])
    step = F.array(F.struct(own.alias("digit"), F.concat_ws("", others).alias("siblings")))
    new = {
        "at": F.col("receiver"),
        "node": F.when(active, F.sha2(F.concat_ws("", nodes).cast("binary"), 256)).otherwise(F.get(nodes, F.lit(0))),
        "up": F.when(active, F.concat("state.up", step)).otherwise(F.col("state.up")),
    }
    return got.select(*[new.get(c, F.col(f"state.{c}")).alias(c) for c in held.columns])


def _rounds(count: int, fanout: int) -> int:
    """Levels above `count` nodes."""
    levels = 0
    while count > 1:
        count, levels = -(-count // fanout), levels + 1
    return levels


def _extent(span: int):
    """struct<start, size> of the subtree of a given number whose whole ones have `span` partitions."""

    def extent(number: Column) -> Column:
        start = F.col("at") - F.col("block") + number * span
        return F.struct(start.alias("start"), F.least(F.lit(span).cast("long"), F.col("blocks") - number * span).alias("size"))

    return extent


def _upper(roots: DataFrame, groups: DataFrame, fanout: int) -> DataFrame:
    """(grp, block, subroot, root, up): every partition with the siblings above it, by rounds of exchanges."""
    held = roots.join(groups, "grp").select(
        "grp", "gid", "block", "blocks", (F.col("base") + F.col("block")).alias("at"), "node",
        F.lit(None).cast("string").alias("subroot"),
        F.array().cast("array<struct<digit int, siblings string>>").alias("up"),
    )
    most, number = groups.agg(F.max("blocks"), F.count(F.lit(1))).first()  # two numbers
    for r in range(_rounds(most or 0, fanout)):
        span = fanout**r
        first = F.floor(F.col("block") / (span * fanout)) * fanout  # subtrees of the group, by their number in this level
        last = F.least(first + fanout, F.ceil(F.col("blocks") / span)) - 1
        subtrees = F.transform(F.sequence(first, last), _extent(span))
        held = _exchange(held, subtrees, F.floor(F.col("block") / span) % fanout, F.col("blocks") > span)
    held = held.withColumn("subroot", F.col("node"))
    for r in range(_rounds(number, fanout)):
        span = fanout**r
        subtree, whole = F.floor(F.col("gid") / span), F.floor(F.col("gid") / (span * fanout))
        extents = groups.groupBy(whole.alias("whole"), subtree.alias("s")).agg(F.min("base").alias("start"), F.sum("blocks").alias("size"))
        extents = extents.groupBy("whole").agg(F.sort_array(F.collect_list(F.struct("start", "size"))).alias("extents"))  # at most `fanout` each
        placed = held.withColumn("whole", whole).join(extents, "whole").drop("whole")
        held = _exchange(placed, F.col("extents"), subtree % fanout, F.lit(True)).drop("extents")
    return held.select("grp", "block", "subroot", F.col("node").alias("root"), "up")


def manifest(docs: DataFrame, fields: list[str], key: str = "doc_id", group: str = "lang", tamper: str = "text", fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    A leaf hashes `fields`; leaves ascend by `key` in each `group`. Where 3 divides the crc32 of the key's decimal
    digits, `folded_root` starts from a leaf whose `tamper` column was lower-cased, else from the row's own.
    """
    leaf = digest(*[field_text(F.col(c)) for c in fields])
    other = digest(*[field_text(lowered_text(F.col(c)) if c == tamper else F.col(c)) for c in fields])
    changed = F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 0  # null for a null key
    leaves = docs.select(
        F.col(key).alias("doc_id"), group_key(F.col(group)).alias("grp"), leaf.alias("leaf"), F.when(changed, other).otherwise(leaf).alias("tampered")
    )
    rows, sizes = _ordered(kept(leaves, "leaves"), ["doc_id", "leaf"], "grp", "ordered")
    groups = kept(_groups(kept(sizes, "sizes"), fanout**levels), "numbered")
    rows = rows.join(groups.select("grp", "n"), "grp").withColumn("block", F.floor(F.col("pos") / fanout**levels)).drop("part")
    roots = rows.select("grp", "block", "n", "pos", "leaf").groupBy("grp", "block").applyInPandas(lambda pdf: _partition_root(pdf, fanout, levels), "grp string, block long, node string")
    upper = kept(_upper(kept(roots, "roots"), groups, fanout), "upper")
    schema = f"doc_id {docs.schema[key].dataType.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return rows.groupBy("grp", "block").cogroup(upper.groupBy("grp", "block")).applyInPandas(lambda a, b: _leaf_proofs(a, b, fanout, levels), schema)
