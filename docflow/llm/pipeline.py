"""The stages of corpus_pipeline.py: documents in, packed sequences out.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns the
columns of documents; the last returns packed pieces. n_chars follows the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut
from .jaccard import jaccard_components
from .lines import remove_boilerplate
from .packing import pack_texts
from .quality import ledger, verdict
from .queries import tokenizer
from .substring import remove_repeats

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _rewritten(out: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents' columns from `rest`, with the text that an operator kept where it removed something."""
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("rest.text"))
    columns = {c: F.col(f"rest.`{c}`") for c in docs.columns} | {"text": text}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("rest.n_chars"))
    return out.select(*(columns[c].alias(c) for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current policy; the others go.

    A null, empty or wordless text has too few words and goes. Every row is judged for
    itself, repeated rows and rows without an id too. Other columns pass through, whatever
    their names; nulls in them play no part.
    """
    return ledger(docs, keep=docs.columns).filter(verdict()).select("rest.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that many sources carry; one of which nothing is left goes.

    Copies of a document count for one source: the next stage keeps one of them. A row
    without a source counts for none and loses such lines too. Null, empty and wordless
    texts go. Repeated rows and rows without an id are rows of their own. Other columns
    pass through, whatever their names; n_chars, where there is one, follows the text.
    """
    out = _rewritten(remove_boilerplate(docs, carry=docs.columns, copies=False), docs)
    return out.filter(out.text.rlike(r"[^\x20\x09-\x0D]"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest id, and of several such the least by a hash of all its columns.

    Rows count one by one, whatever ids they share; a row without an id comes after those
    that have one. A row that is repeated in all columns goes on once. Texts without words
    link to nothing and stay. Other columns pass through, whatever their names.
    """
    row_key = F.xxhash64(*docs.columns, *(F.col(c).isNull() for c in docs.columns)).alias("row_key")  # null columns alone leave no trace in it
    found = jaccard_components(docs.select("doc_id", "text", row_key), row_col="row_key").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    rows = found.groupBy("component", "row_key").agg(F.count("*").alias("n"))
    alone = F.when(F.col("component").isNull(), F.col("row_key"))  # texts without words are groups of their own
    first = rows.groupBy("component", alone.alias("alone")).agg(F.min("row_key").alias("row_key"), F.min_by("n", "row_key").alias("n"))
    kept = cut(first.select("row_key", "n"), "kept")
    keyed = docs.select(row_key, F.struct(*docs.columns).alias("rest"))
    once = keyed.join(kept.filter("n = 1"), "row_key", "left_semi")
    again = keyed.join(kept.filter("n > 1"), "row_key", "left_semi").dropDuplicates(["row_key"])
    return once.unionByName(again).select("rest.*")


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated passages; one of which nothing is left goes.

    Null, empty and wordless texts go. A row that is repeated, or a long text that two rows
    have, is a repeated passage as a whole: near_duplicates has left one of each. Rows
    without an id are rows of their own. Where something goes, the words left are joined by
    one space, and n_chars, where there is one, follows. Other columns pass through,
    whatever their names.
    """
    out = _rewritten(remove_repeats(docs, carry=docs.columns), docs)
    return out.filter(out.text.rlike(r"[^\x20\x09-\x0D]"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    Null and empty texts are their end token. Repeated rows and rows without an id are packed
    each for itself. Which rows share a sequence depends on the order in which the table's
    partitions give them. Other columns play no part.
    """
    return pack_texts(docs, tokenizer("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", passages),
    ("packing", packing),
]

#: SQL has no byte-pair encoder; tests/llm hold the stages against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
