"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document. The ledger keeps its measurements and one long
in which bit k tells that rule k failed. A policy is a mask with a version; applying it is
a bitwise AND, and comparing policies or leaving a rule out is bitwise aggregation over the
ledger, with no text read again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"

#: Rules in bit order: name -> SQL condition over the measurements that tells a failure.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "10 * n_symbols > 3 * n_words",
    "many_exclamations": "n_exclaim > n_words",
    "short_or_long_words": "word_chars < 2 * n_words or word_chars > 25 * n_words",
    "repeated_lines": "n_lines >= 4 and 10 * n_dup_lines > 7 * n_lines",
}


def mask(*names: str) -> int:
    return sum(1 << list(RULES).index(n) for n in names)


#: Policies by version. A version never changes once published; new rules make new versions.
POLICIES: dict[str, int] = {
    "base": mask("few_words", "repeated_windows"),
    "v1": mask(*RULES),
}
CURRENT = "v1"


def _bind(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda variable, not an expression copied into each use."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more, first occurrences included.

    Windows are sorted by hash with their places; places beside an equal hash are kept, sorted,
    and each adds the words that the one before did not cover.
    """

    def covered(ws: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(ws) - 3), lambda i: F.struct(F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)).alias("h"), i.alias("p")))

        def places(s: Column) -> Column:
            twin = lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])
            return F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(twin(x, i), F.get(s, i - 1)["h"] == x["h"], F.get(s, i + 1)["h"] == x["h"], F.lit(False))), lambda x: x["p"]))

        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last"))
        return F.aggregate(_bind(F.sort_array(windows), places), start, step, lambda a: a["n"])

    return F.when(F.size(words) >= 4, _bind(words, covered)).otherwise(0).cast("long")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """One row per document: id_col, the measurements, failures (bit k: rule k failed) and `keep` as a struct `rest`.

    Words are runs of characters other than U+0020 and U+0009..U+000D. n_words; word_chars
    (code points in words); n_symbols (of # * $ % & | < >); n_exclaim; n_lines and
    n_dup_lines (lines cut at \\n that hold a word; those equal to an earlier one);
    n_repeat_words. Null texts measure as empty ones, which have no words and fail few_words
    only. Rows with equal or null ids each have their own row. There is no shuffle.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rest = [F.struct(*keep).alias("rest")] if keep else []
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), *rest)

    def measure(words: Column) -> Column:
        lines = lambda ls: F.struct(F.size(ls).cast("long").alias("n"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("dup"))
        solid = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            F.regexp_count("text", F.lit("!")).cast("long").alias("n_exclaim"),
            _bind(solid, lines).alias("lines"),
            _repeated_words(words).alias("n_repeat_words"),
        )

    words = F.filter(F.split("text", SPACES, -1), lambda w: w != "")
    found = base.select("doc_id", *(["rest"] if keep else []), _bind(words, measure).alias("m"))
    found = found.select("doc_id", *(["rest"] if keep else []), "m.n_words", "m.word_chars", "m.n_symbols", "m.n_exclaim", F.col("m.lines.n").alias("n_lines"), F.col("m.lines.dup").alias("n_dup_lines"), "m.n_repeat_words")
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, rule in enumerate(RULES.values())]
    failures = bits[0].cast("long")
    for b in bits[1:]:
        failures = failures.bitwiseOR(b.cast("long"))
    return found.withColumn("failures", failures).withColumnRenamed("doc_id", id_col)


def verdict(version: str = CURRENT, policies: Mapping[str, int] = POLICIES) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("failures").bitwiseAND(F.lit(policies[version]).cast("long")) == 0


def ablation(rows: DataFrame, version: str = CURRENT, policies: Mapping[str, int] = POLICIES) -> DataFrame:
    """What each rule of a policy does: rejected (rows it fails), only (rows no other rule of the policy fails).

    One pass over the ledger: counts of set bits, and of masks with a single bit. A row per
    rule of the policy; an empty ledger gives zeros.
    """
    chosen = policies[version]
    hit = F.col("failures").bitwiseAND(F.lit(chosen).cast("long"))
    rules = [(k, name) for k, name in enumerate(RULES) if chosen >> k & 1]
    count = lambda c, name: F.count_if(c).alias(name)
    sums = rows.agg(*(count(hit.bitwiseAND(F.lit(1 << k).cast("long")) != 0, f"r{k}") for k, _ in rules), *(count(hit == (1 << k), f"o{k}") for k, _ in rules))
    each = F.array(*(F.struct(F.lit(name).alias("rule"), F.col(f"r{k}").alias("rejected"), F.col(f"o{k}").alias("only")) for k, name in rules))
    return sums.select(F.inline(each))
