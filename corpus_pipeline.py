"""From raw documents to packed token sequences, stage by stage.

Each stage takes the documents that the one before it kept, and is written as Parquet before the
next one reads them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm import decontaminate, packing, pii, simhash, toxicity
from tablelens.llm.queries import COVERED_FROM, PSEUDONYM_KEY, TOXIC_FROM, table, tokenizer_path, training_labels
from tablelens.session import scratch_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network scores below the threshold; it learns from the labelled ones among them."""
    model = toxicity.train(docs, training_labels(spark, sf_dir, "toxic"))
    return toxicity.without_toxic(docs, model, TOXIC_FROM)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: fingerprints of three-word shingles, three bits apart at most."""
    return simhash.one_of_each(docs, bits=3, shingle=3)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"), COVERED_FROM)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms in place; n_chars follows the new text."""
    out = pii.pseudonymize(docs, PSEUDONYM_KEY)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, with their token ids and their place in a sequence."""
    return packing.pack(docs, tokenizer_path()).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal data", replace_personal_data),
    ("packing", pack_sequences),
]

#: A trained network, fingerprints and a tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of the `documents` table in `sf_dir`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_dir(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
