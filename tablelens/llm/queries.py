"""One registered query per training-data operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm import debruijn, decontaminate, katz, lexical, merkle, packing, pieces, pii, quality, simhash, topk, toxicity, urls
from tablelens.llm.common import crc_remainder

#: Stands for the secret that a real run is given.
PSEUDONYM_KEY = "pseudonym-key-1"
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Rows of labels that toxicity and quality learn from: those whose remainder modulo FOLDS is not HELD.
FOLDS, HELD = 4, 2
TOXIC_FROM = 0.3
COVERED_FROM = 0.5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def training_labels(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where(crc_remainder(F.col("doc_id"), FOLDS) != HELD).select("doc_id", column)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, their source as host and their language as path."""
    return quality.judge(table(spark, sf_dir, "documents"), training_labels(spark, sf_dir, "quality"), "source", "lang").withColumn(
        "held_out", crc_remainder(F.col("doc_id"), FOLDS) == HELD
    )


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path()).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "cost"
    )


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), training_labels(spark, sf_dir, "quality"), URL_RULES)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that cover an item, with the items."""
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), COVERED_FROM)
    return found.select("doc_id", "item_id", "covered", "item_words", "coverage", F.size("tiles").alias("n_tiles"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, training_labels(spark, sf_dir, "toxic"))
    return toxicity.toxicity(docs, model).select(
        "doc_id",
        (crc_remainder(F.col("doc_id"), FOLDS) == HELD).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"),
    )


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.language_model_scores(table(spark, sf_dir, "documents"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.without_repeats(table(spark, sf_dir, "documents"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded texts; `agrees`: the library encodes the text alike."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return pieces.decode(coded, model).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        "agrees",
    )


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"])


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query functions by name."""
    return {
        "op1_hierarchical_quality": op1,
        "op2_cost_balanced_packing": op2,
        "op3_url_templates": op3,
        "op4_feistel_pseudonyms": op4,
        "op5_greedy_string_tiling": op5,
        "op6_anchor_simhash": op6,
        "op7_toxicity_network": op7,
        "op8_katz_backoff": op8,
        "op9_threshold_top_k": op9,
        "op10_debruijn_dedup": op10,
        "op11_piece_agenda": op11,
        "op12_limited_accumulators": op12,
        "op13_butterfly_manifest": op13,
    }
