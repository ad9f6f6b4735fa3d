"""Removal of boilerplate lines by how many sites carry them, in DataFrame functions only.

Each line hash gets a HyperLogLog sketch of its sites, merged by aggregation: partial
sketches before the shuffle, so that a line on a third of all pages moves as a few small
sketches. Lines clearly below or above the threshold are decided by the sketch; those whose
estimate lies near it have their distinct sites counted exactly. Lines of fewer than
MIN_WORDS words are no boilerplate: in a large corpus ordinary short lines stand everywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

MIN_SITES, MIN_WORDS = 10, 3
LOG_K = 8  # 2**8 registers: a relative error of about 1.04 / 16
WHITE, _WHITE = " \t\x0b\f\r", r" \t\x0b\f\r"
SURE = 0.5  # estimates within this share of the threshold are counted exactly (over 7 standard errors)


def boilerplate(docs: DataFrame, text: str, site: str, min_sites: int = MIN_SITES, copies: bool = True) -> DataFrame:
    """line_hash of each line (cut at \\n, white space around it off) of MIN_WORDS words or more that stands on min_sites sites or more.

    Without copies, texts of the same lines count for one site, the least of theirs.
    """
    line = F.explode(F.split(F.col(text), "\n", -1))
    lines = docs.filter(F.col(site).isNotNull()).select(F.col(site).alias("site"), line.alias("line"))
    lines = lines.select(_hash("line").alias("line_hash"), F.xxhash64("site").alias("site")).filter("line_hash is not null")
    sketches = lines.groupBy("line_hash").agg(F.hll_sketch_agg("site", F.lit(LOG_K)).alias("sites"), F.count("*").alias("n")).filter(F.col("n") >= min_sites)
    spread = cut(sketches.select("line_hash", F.hll_sketch_estimate("sites").alias("about")).filter(F.col("about") >= min_sites * (1 - SURE)), "spread")
    if not copies:  # sites of all copies bound those of distinct texts from above, so only lines of the spread can qualify
        keyed = docs.filter(F.col(site).isNotNull()).select(F.col(site).alias("site"), F.col(text).alias("text"), _text_key(text).alias("text_key"))
        held = keyed.select("site", "text_key", F.explode(F.split("text", "\n", -1)).alias("line")).withColumn("line_hash", _hash("line"))
        held = held.join(spread.select("line_hash"), "line_hash").groupBy("line_hash", "text_key").agg(F.min("site").alias("site"))
        return held.select("line_hash", "site").distinct().groupBy("line_hash").agg(F.count("*").alias("n")).filter(F.col("n") >= min_sites).select("line_hash")
    sure = spread.filter(F.col("about") > min_sites * (1 + SURE)).select("line_hash")
    near = spread.filter(F.col("about") <= min_sites * (1 + SURE)).select("line_hash")
    exact = lines.join(near, "line_hash").distinct().groupBy("line_hash").agg(F.count("*").alias("n")).filter(F.col("n") >= min_sites)
    return sure.unionByName(exact.select("line_hash"))


def _hash(line: str, min_words: int = MIN_WORDS):
    """Hash of a line without the white space around it; null for a line of fewer than min_words words."""
    bare = F.btrim(F.col(line), F.lit(WHITE))
    return F.when(bare.rlike(rf"^(?:[^{_WHITE}]+[{_WHITE}]+){{{min_words - 1}}}[^{_WHITE}]"), F.xxhash64(bare))


def _text_key(text: str):
    """Hash of a text's lines in order, without blank ones and the white space around them."""
    bare = F.transform(F.split(F.col(text), "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)))
    return F.xxhash64(F.filter(bare, lambda x: x != ""))


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, carry: Sequence[str] = (), copies: bool = True) -> DataFrame:
    """Remove lines of MIN_WORDS words or more that stand on min_sites distinct sites or more, from every document.

    Returns id_col, n_lines (lines that hold more than white space), n_removed, kept_text
    (the other lines in order, joined by \\n) and, if carry names columns, `rest`, a struct
    of them. Lines are compared without the white space around them. A null site counts for
    no line but its documents lose boilerplate too. Null texts have no lines and an empty
    kept_text. Rows with equal ids are rows of their own. Other columns play no part.
    Without copies, documents of the same lines count for one site, the least of theirs: a
    document that is copied to many sites keeps its lines, and its copies theirs.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rest = [F.struct(*carry).alias("rest")] if carry else []
    source = docs.select(F.xxhash64(F.col(id_col), text).alias("row_key"), F.col(id_col).alias("doc_id"), F.col(site_col).alias("site"), text.alias("text"), *rest)
    common = cut(boilerplate(source, "text", "site", min_sites, copies).distinct(), "boilerplate")
    lines = source.select("row_key", F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
    hits = lines.select("row_key", "place", _hash("line").alias("line_hash")).join(common, "line_hash", "left_semi")
    gone = hits.groupBy("row_key").agg(F.array_sort(F.collect_set("place")).alias("gone"))
    out = source.join(gone, "row_key", "left")
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(_without(F.split("text", "\n", -1), F.col("gone")), "\n"))
    solid = F.size(F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)) != "")).cast("long")
    return out.select(F.col("doc_id").alias(id_col), *(["rest"] if carry else []), solid.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), kept.alias("kept_text"))


def _without(parts, gone):
    """parts without the places in gone (ascending): the runs between them, so each part is copied once."""
    upto = F.concat(gone, F.array(F.size(parts)))
    runs = lambda xs: F.flatten(F.transform(upto, lambda end, i: _run(xs, F.when(i > 0, F.get(gone, i - 1) + 1).otherwise(0), end)))
    return F.get(F.transform(F.array(parts), runs), F.lit(0))  # bound in a lambda: split once


def _run(xs, start, end):
    return F.slice(xs, start + 1, end - start)
