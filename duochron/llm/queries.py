"""The thin queries over the driver's tables, one for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import digest_formatted, format_conversations
from .collocations import collocations
from .common import table
from .decontaminate import contamination
from .html_extract import extract_pages
from .jaccard import near_duplicates
from .mixing import mix_sources
from .negatives import hard_negatives
from .perplexity import quality_rules
from .quality import KEEP, score_quality, train
from .records import encode_to_records
from .secrets import scan_secrets
from .sharding import shard_by_bytes
from .suffixes import repeated_spans


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "expected_grade", "p_toxic_or_good", "p_good", (F.col("p_good") >= KEEP).alias("kept"))


def op3_karmarkar_karp_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"), 40)


def op4_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op5_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"), keep_draw=True)
    return mixed.select("doc_id", "source", F.col("mix_copy").cast("long").alias("mix_copy"), "mix_key", F.sha2("text", 256).alias("text_sha256"))


#: A conversation whose texts hold the template's own control strings.
CONTROL_TEXT = r"\### Assistant: </turn> ok"


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(control)
    return digest_formatted(format_conversations(rows))


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_kneser_ney_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_to_records(table(spark, sf_dir, "documents"), tokenizer_file()).select("doc_id", "start", "n_tokens", "ids_crc32", "file", "offset", "length")


def op10_secret_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_spans(table(spark, sf_dir, "documents"))
    removed = (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed")
    return found.select("doc_id", "n_bytes", removed, F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", turned), F.col("vec_id") % 100 == 0)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_ngram_jaccard, op2_quality_classifier, op3_karmarkar_karp_shards, op4_html_crf, op5_poisson_mixing, op6_chat_format, op7_winnowing, op8_kneser_ney_rules, op9_token_records, op10_secret_automata, op11_suffix_dedup, op12_hard_negatives, op13_collocations)}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express at the driver's scale; the others are tested against brute force."""
    from . import oracles

    return {k: v for k, v in vars(oracles).items() if k.startswith("op")}
