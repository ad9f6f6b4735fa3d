"""The opN_ queries: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dpbpe import decode_ids, encode_texts
from .heapbpe import count_tokens
from .jaccard import jaccard_components
from .lines import remove_boilerplate
from .lm import score_texts
from .oracle import ORACLE_SQL
from .packing import END_ID, SIZE, pack_texts
from .quality import ablation, ledger, verdict
from .substring import remove_repeats
from .topk import top_k
from .toxicity import classify


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_documents(spark, sf_dir))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack_texts(_documents(spark, sf_dir), tokenizer("word_bpe_49k.json"), size=SIZE, end_id=END_ID)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_documents(spark, sf_dir))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(_documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(_documents(spark, sf_dir)).withColumns({"base_failed": ~verdict("base"), "kept": verdict()})
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failures")


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each rule of the current policy, how many documents fail it, and how many fail no other: a second reading of op6's ledger."""
    return ablation(ledger(_documents(spark, sf_dir)))


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_boilerplate(_documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer("byte_bpe_50k.json")
    out = decode_ids(encode_texts(_documents(spark, sf_dir), path), path)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = (op1_toxicity, op2_lm_score, op3_packing, op4_jaccard_join, op5_substring_dedup, op6_quality_rules, op7_topk_search, op8_line_dedup, op9_token_counts, op10_bpe_codec, quality_ablation)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
