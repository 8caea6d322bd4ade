"""Session settings shared by the entry points, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# Input per core below which a table is spread before heavy per-row work.
SPREAD_BYTES = 128 * 1024 * 1024
# Above this many rows a lookup table is left for Spark to join as it sees fit.
BROADCAST_ROWS = 200_000
# The same for file blocks: 120 TB in splits of 128 MB, a table of about 200 MB.
BROADCAST_BLOCKS = 1_000_000


def scratch_base(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Only a session that names none (a local test) gets a temporary folder, once.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if not named:
        named = tempfile.mkdtemp(prefix="tablelens-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh path for one run's files below the shared folder."""
    return f"{scratch_base(spark)}/tablelens/{label}-{uuid.uuid4().hex}"


def input_bytes(df: DataFrame) -> int:
    """Spark's estimate of a table's size; no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """Deal a small input out to all cores; leave a large one where it is.

    A file with one row group is one task, however long its rows take. Below one split
    size per core, moving the rows costs less than leaving cores idle, and the bound keeps
    that shuffle small. Tables beyond it have more splits than cores and are not moved, and
    neither are those whose rows lie evenly in as many splits as there are cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if input_bytes(df) >= cores * SPREAD_BYTES or _is_spread(df, cores):
        return df
    return df.repartition(cores)


def _is_spread(df: DataFrame, cores: int) -> bool:
    """Does no split of a file scan hold over twice a core's share? Counting reads the footers of Parquet files only."""
    if not df.inputFiles() or df.rdd.getNumPartitions() < cores:
        return False
    split = df.select(F.spark_partition_id().alias("split")).groupBy("split").count()
    most, rows = split.agg(F.max("count"), F.sum("count")).first()
    return rows is not None and most * cores <= 2 * rows
