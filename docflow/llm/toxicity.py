"""Toxicity by a classifier chain of linear models over hashed words, word prefixes and marks of form.

Categories are predicted in a fixed order. The model of each category sees the words and
the probabilities that the models before it give. In training those are out of fold: each
labelled row's come from models that did not see the row, as they will at prediction.

Labels are learned from a bounded sample (SAMPLE ids, those of the least hashes). Spark
counts its features; the CANDIDATES of highest chi-square go to the driver, of each row
those it has, so that neither rows nor their lengths are unbounded there. The model is at
most FEATURES weights per category and goes to the executors. Scoring is one pass over the
documents with no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import cut

#: Category -> SQL condition over the label columns, in chain order.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}
SAMPLE, FEATURES, FOLDS, LEAST = 12_000, 1024, 4, 5
CANDIDATES = 1 << 14
CHI = 25.0  # features below this chi-square are left out
BITS = 22  # features are hashed to 2**BITS
PREFIXES = (4, 5, 6)  # bytes of a word's prefix
#: Words here are runs of ASCII letters and non-ASCII bytes.
_SPLIT = np.ones(256, bool)
_SPLIT[65:91] = _SPLIT[97:123] = _SPLIT[128:] = False
_SYMBOL = np.zeros(256, bool)
_SYMBOL[33:48] = _SYMBOL[58:65] = _SYMBOL[91:97] = _SYMBOL[123:127] = True


def features(column) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) pairs, each once, sorted: the lower-cased words, their prefixes and marks of form."""
    raw, offsets = K.binary_buffers(column)
    table = K._TABLE[K.LOWER]
    docs, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo, hi in K.pieces(raw, offsets, _SPLIT):
        part = raw[lo:hi]
        inner = offsets[np.searchsorted(offsets, lo, "right") : np.searchsorted(offsets, hi, "left")] - lo
        starts, ends = K._words_of(part, inner, _SPLIT)
        doc = np.searchsorted(offsets, starts + lo, "right") - 1
        keys = [K._hashes(part, starts, ends, table)]
        docs_of = [doc]
        for n in PREFIXES:
            long = ends - starts > n
            keys.append(K.mix(K._hashes(part, starts[long], starts[long] + n, table) + np.uint64(n)))
            docs_of.append(doc[long])
        for at, key in _shapes(part, starts, keys[0]):
            keys.append(key)
            docs_of.append(np.searchsorted(offsets, at + lo, "right") - 1)
        key = (np.concatenate(keys) >> np.uint64(64 - BITS)).astype(np.int64)
        both = np.unique(np.concatenate(docs_of) << BITS | key)
        docs.append(both >> BITS)
        found.append(both & (1 << BITS) - 1)
    both = np.unique(np.concatenate(docs) << BITS | np.concatenate(found))  # a long text spans several pieces
    return both >> BITS, both & (1 << BITS) - 1


def _shapes(raw: np.ndarray, starts: np.ndarray, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, key) of marks of form: each kind of symbol, pairs of symbols, and a word three times in a row."""
    at = np.flatnonzero(_SYMBOL[raw])
    yield at, K.mix(raw[at].astype(np.uint64) + np.uint64(1 << 40))
    two = at[:-1][np.diff(at) == 1] if len(at) else at
    yield two, K.mix(raw[two].astype(np.uint64) << np.uint64(8) | raw[two + 1].astype(np.uint64) | np.uint64(1 << 41))
    thrice = np.flatnonzero((words[2:] == words[1:-1]) & (words[1:-1] == words[:-2])) if len(words) > 2 else np.zeros(0, np.int64)
    yield starts[thrice], np.full(len(thrice), K.mix(np.array([1 << 42], np.uint64))[0])


@dataclass
class Linear:
    """A logistic model over chosen hashed features and the chain's probabilities."""

    chosen: np.ndarray  # sorted
    weight: np.ndarray
    chain: np.ndarray
    bias: float

    def logit(self, doc: np.ndarray, feature: np.ndarray, chain: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.chosen, feature), max(len(self.chosen) - 1, 0))
        out = np.full(len(chain), self.bias) + (chain @ self.chain if chain.shape[1] else 0.0)
        if len(self.chosen):
            hit = self.chosen[at] == feature
            out += np.bincount(doc[hit], self.weight[at[hit]], len(chain))
        return out


def fit(doc: np.ndarray, feature: np.ndarray, chain: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.2, decay: float = 1e-2) -> Linear:
    """Logistic regression on the FEATURES features of highest chi-square; Adam steps over all rows."""
    n, positive = len(y), float(y.sum())
    if not n or positive in (0.0, float(n)):
        return Linear(np.zeros(0, np.int64), np.zeros(0), np.zeros(chain.shape[1]), 12.0 if n and positive else -12.0)
    df = np.bincount(feature, minlength=1 << BITS).astype(np.float64)
    with_y = np.bincount(feature, y[doc].astype(np.float64), 1 << BITS)
    expected = df * positive / n
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = np.where(df >= LEAST, (with_y - expected) ** 2 / (expected * (1 - positive / n)), 0.0)
    chosen = np.sort(np.argsort(-chi, kind="stable")[:FEATURES])
    chosen = chosen[chi[chosen] > CHI]
    at = np.minimum(np.searchsorted(chosen, feature), max(len(chosen) - 1, 0))
    hit = chosen[at] == feature if len(chosen) else np.zeros(len(feature), bool)
    rows, cols = doc[hit], at[hit]
    size = len(chosen) + chain.shape[1] + 1
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    w[-1] = np.log(positive / (n - positive))
    for step in range(1, rounds + 1):
        z = w[-1] + np.bincount(rows, w[cols], n) + chain @ w[len(chosen) : -1]
        gap = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        grad = np.concatenate([np.bincount(cols, gap[rows], len(chosen)) / n, chain.T @ gap / n, [gap.mean()]])
        grad[:-1] += decay * w[:-1] / np.sqrt(n)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return Linear(chosen, w[: len(chosen)], w[len(chosen) : -1], float(w[-1]))


def fit_chain(doc: np.ndarray, feature: np.ndarray, labels: np.ndarray, folds: int = FOLDS) -> list[Linear]:
    """A model per column of labels; the inputs that later models get are out-of-fold probabilities.

    A row whose label in a column is not a number teaches that column's model nothing.
    """
    n, k = labels.shape
    fold, chain, models = np.arange(n) % folds, np.zeros((n, 0)), []

    def fitted(c: int, seen: np.ndarray) -> Linear:
        new, mine = np.cumsum(seen) - 1, seen[doc]
        return fit(new[doc[mine]], feature[mine], chain[seen], labels[seen, c])

    for c in range(k):
        known = ~np.isnan(labels[:, c])
        models.append(fitted(c, known))
        if c + 1 < k:
            out = np.zeros(n)
            for f in range(folds):
                out[fold == f] = fitted(c, known & (fold != f)).logit(doc, feature, chain)[fold == f]
            chain = np.concatenate([chain, _probability(out)[:, None]], 1)
    return models


def _probability(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -15, 15)))


def predict(models: list[Linear], doc: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
    """Probabilities of each category, a column each."""
    chain = np.zeros((n, 0))
    for model in models:
        chain = np.concatenate([chain, _probability(model.logit(doc, feature, chain))[:, None]], 1)
    return chain


def candidates(rows: DataFrame, k: int, size: int = CANDIDATES) -> np.ndarray:
    """The `size` features of rows (text, y0, y1, ...) with the highest chi-square for any of k labels, in ascending order."""
    names = [f"{x}{i}" for i in range(k) for x in "np"]  # labelled rows with the feature, and positive ones among them

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                doc, feature = features(K.ids_of(part, "text"))
                found, at = np.unique(feature, return_inverse=True)
                sums = []
                for y in _labels(part, k).T:
                    sums += [np.bincount(at, ~np.isnan(y[doc]), len(found)), np.bincount(at, np.nan_to_num(y[doc]), len(found))]
                yield pa.RecordBatch.from_arrays([pa.array(found), *(pa.array(x.astype(np.int64)) for x in sums)], names=["feature", *names])

    counts = rows.mapInArrow(count, "feature long, " + ", ".join(f"{x} long" for x in names)).groupBy("feature").agg(*(F.sum(x).alias(x) for x in names))
    total = rows.agg(*(F.count(f"y{i}").alias(f"n{i}") for i in range(k)), *(F.count_if(f"y{i}").alias(f"p{i}") for i in range(k))).first()
    score = F.lit(0.0)
    for i in range(k):
        share = total[f"p{i}"] / total[f"n{i}"] if total[f"n{i}"] else 0.0
        if 0 < share < 1:
            n = F.col(f"n{i}")
            score = F.greatest(score, F.when(n >= LEAST, (F.col(f"p{i}") - n * share) ** 2 / (n * share * (1 - share))).otherwise(0.0))
    best = counts.withColumn("chi", score).filter("chi > 0").orderBy(F.desc("chi"), "feature").limit(size)
    return np.sort(best.select("feature").toArrow().column("feature").to_numpy())


def _labels(batch: pa.RecordBatch | pa.Table, k: int) -> np.ndarray:
    """A column of 0, 1 or, for null, not a number for each label."""
    return np.stack([batch.column(f"y{i}").cast(pa.int8()).cast(pa.float64()).to_numpy(zero_copy_only=False) for i in range(k)], 1)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", categories: dict[str, str] | None = None, sample: int = SAMPLE) -> list[Linear]:
    """Fit the chain on at most `sample` labelled ids: those with the least hashes.

    Rows without a document or with a null id are left out, and so is, for one category, a
    row whose label does not decide it. An id that is labelled more than once has a category
    if any of its rows says so; each of its documents is a row.
    """
    rules = list((categories or CATEGORIES).values())
    ys = [f"y{i}" for i in range(len(rules))]
    named = labels.select(F.col(id_col).alias("id"), *(F.expr(r).alias(y) for r, y in zip(rules, ys, strict=True))).filter("id is not null").groupBy("id").agg(*(F.bool_or(y).alias(y) for y in ys))
    few = named.filter(F.coalesce(*ys).isNotNull()).orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = cut(texts.join(F.broadcast(few), "id").select(F.xxhash64("id", "text").alias("h"), "text", *ys), "labelled")  # at most `sample` ids
    chosen = candidates(rows, len(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                doc, feature = features(K.ids_of(part, "text"))
                kept = np.isin(feature, chosen)
                doc, feature = doc[kept], feature[kept]
                at = np.searchsorted(doc, np.arange(part.num_rows + 1))
                blob = feature.astype(np.int32).tobytes()
                packed = [blob[4 * a : 4 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([K.ids_of(part, "h"), pa.array(packed, pa.binary()), *(K.ids_of(part, y) for y in ys)], names=["h", "found", *ys])

    schema = "h long, found binary, " + ", ".join(f"{y} boolean" for y in ys)
    got = rows.mapInArrow(run, schema).toArrow().sort_by("h")
    found = [np.frombuffer(x.as_buffer(), np.int32) for x in got.column("found")]
    doc = np.repeat(np.arange(len(found)), [len(x) for x in found])
    feature = np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)
    return fit_chain(doc, feature, _labels(got, len(rules)))


def score(docs: DataFrame, models: list[Linear], id_col: str = "doc_id", text_col: str = "text", categories: dict[str, str] | None = None) -> DataFrame:
    """id_col and p_<category> for every document; every row gives a row. Null texts score as empty ones."""
    names = [f"p_{c}" for c in categories or CATEGORIES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                doc, feature = features(K.ids_of(part, "text"))
                p = predict(models, doc, feature, part.num_rows)
                yield pa.RecordBatch.from_arrays([K.ids_of(part, "id"), *(pa.array(p[:, i]) for i in range(len(names)))], names=["id", *names])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, " + ", ".join(f"{n} double" for n in names)).withColumnRenamed("id", id_col)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Train on labels and score all documents: id_col, p_low_quality, p_toxic, is_toxic.

    Without labels, or with labels all alike, each probability is (nearly) 0 or 1 throughout;
    with none, 0. Other columns of either table play no part.
    """
    scored = score(docs, train(docs, labels, id_col, text_col), id_col, text_col)
    return scored.withColumn("is_toxic", F.col("p_toxic") >= threshold)
