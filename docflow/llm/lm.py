"""An n-gram language model (order 3) as a weighted backoff automaton, trained and applied in one job.

States are the histories seen in training: pairs of tokens, single tokens, and the root (no
history). Pairs and tokens may begin with the marks before a text. A state h reached by
c(h) training tokens has an arc for every token w seen after it, weighted

    log10((c(h w) + m * p(w | shorter h)) / (c(h) + m)),

that leads to the longest suffix of h w that is a state, and a failure arc to its shorter
history, weighted log10(m / (c(h) + m)). The root's arcs are the words, with absolutely
discounted weights log10((c(w) - d) / N), and one arc for any word never seen, with the
discounted mass log10(d * V / N). So each state's weights sum to one. m, one number for each
order, is not set: it is where the failure arcs get, over all training tokens, the mass that
tokens would fail with if each were left out of its own counts (those of n-grams seen once).

No executor holds the model. Documents are dealt to batches by a hash of their id and text.
A batch sends its distinct words, bigrams and trigrams, with its own training counts, to the
count buckets; a bucket sums them over batches and answers each batch with totals in the
order asked. So a batch gets the part of the automaton that its documents can reach, and no
more. Texts travel compressed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import group_keys, input_bytes, pieces

BATCH_BYTES, BUCKET_BYTES = 4 << 20, 4 << 20
FOLDS, HELD_OUT = 7, 2
ORDER = 3
_END = np.uint64(0x656E64206F662074)  # the end token, outside the hashes of words but for chance
_START, _STARTS = np.uint64(0x7374617274206F66), np.uint64(0x6265666F72652061)  # the history before a text's first token
_STEP = np.uint64(0x9E3779B97F4A7C15)
GRID = 2.0 ** np.arange(-2, 18, 2)  # values of m at which buckets add up the failing mass
_COUNTS = 6  # tokens, types, words seen once and twice, bigrams and trigrams seen once


def tokens(column) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes with an end token after each text, first token of each text and an end mark)."""
    h, first, _, _ = K.words(column, lower=True)
    n = len(first) - 1
    out = np.empty(len(h) + n, np.uint64)
    start = first + np.arange(n + 1)
    ends = start[1:] - 1
    body = np.ones(len(out), bool)
    body[ends] = False
    out[body], out[ends] = h, _END
    return out, start


def longer(before: np.ndarray, t: np.ndarray, start: np.ndarray, mark: np.uint64) -> np.ndarray:
    """Hash of each token with the n-gram that ends before it; `mark` stands before a text's first token."""
    out = np.empty(len(t), np.uint64)
    out[1:] = before[:-1]
    out[start[:-1]] = mark
    out *= _STEP
    out += t
    return K.mix(out)


def key_bits(size: int) -> int:
    """Bits that bigrams and trigrams keep: 16 more than the input's bytes need, so that one n-gram in 400,000 or fewer meets another's hash."""
    return min(64, max(44, 16 + size.bit_length()))


def _grams(t: np.ndarray, start: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bits, keys) of each order's n-grams."""
    yield 64, t
    short = np.uint64(64 - bits)
    gram = t
    for mark in (_START, _STARTS):
        gram = longer(gram, t, start, mark)
        yield bits, gram >> short


def _asked(column, train: np.ndarray, bits: int):
    """The batch's texts' starts and, for each order, (bits, distinct keys, index of each token, training counts)."""
    t, start = tokens(column)
    learn = np.repeat(train, np.diff(start))
    asked = []
    for width, keys in _grams(t, start, bits):
        distinct, at = np.unique(keys, return_inverse=True)
        at = at.astype(np.int32)
        asked.append((width, distinct, at, np.bincount(at[learn], minlength=len(distinct))))
    return t, start, asked


def _buckets(keys: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bounds of each bucket in sorted keys: buckets are ranges of the hash."""
    edges = [(b << bits) // n for b in range(1, n)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(edges, np.uint64)), [len(keys)]]).astype(np.int64)


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers byte by byte, lowest bytes first, only as many planes as the largest needs: like bytes lie together, which shuffles compress."""
    values = values.astype(np.uint64)
    n = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return values.view(np.uint8).reshape(-1, 8)[:, :n].T.tobytes() + bytes([n])


def _numbers(raw: pa.Buffer) -> np.ndarray:
    all_bytes = np.frombuffer(raw, np.uint8)
    n = int(all_bytes[-1])
    out = np.zeros(((len(all_bytes) - 1) // n, 8), np.uint8)
    out[:, :n] = all_bytes[:-1].reshape(n, -1).T
    return out.view(np.uint64).ravel()


def _keys(raw: pa.Buffer) -> np.ndarray:
    return np.cumsum(_numbers(raw), dtype=np.uint64)


def _unpacked(table: pa.Table) -> tuple[pa.Table, pa.Array, np.ndarray]:
    """(rows in order of their key, texts, which of them are for training)."""
    table = table.sort_by([("row_key", "ascending")])
    unpack = zstandard.ZstdDecompressor().decompress
    texts = pa.array([unpack(x.as_buffer()) for x in table.column("packed")], pa.large_binary())
    return table, texts, table.column("train").to_numpy(zero_copy_only=False).astype(bool)


def _pack(n_batches: int):
    names = ["row_key", "doc_id", "train"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, of = zstandard.ZstdCompressor(level=3).compress, group_keys(n_batches)
        for batch in batches:
            raw, offsets = K.binary_buffers(K.ids_of(batch, "text"))
            ends = offsets.tolist()
            packed = pa.array([pack(raw[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
            home = of[np.mod(K.ids_of(batch, "row_key").to_numpy(), n_batches)]
            yield pa.RecordBatch.from_arrays([pa.array(home), *(K.ids_of(batch, c) for c in names), packed], names=["batch", *names, "packed"])

    return run


_ASKED = [f"{x}{n}" for n in range(1, ORDER + 1) for x in ("keys", "counts")]
_TOTALS = [f"totals{n}" for n in range(1, ORDER + 1)]


def _ask(buckets: int, bits: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        _, texts, train = _unpacked(table)
        del table
        _, _, asked = _asked(texts, train, bits)
        out: list[list] = []
        for width, distinct, _, n in asked:
            edge = _buckets(distinct, buckets, width).tolist()
            parts = list(zip(edge[:-1], edge[1:], strict=True))
            out.append([_planes(np.diff(distinct[a:b], prepend=np.uint64(0))) for a, b in parts])
            out.append([_planes(n[a:b]) for a, b in parts])
        del asked
        K.trim()
        return pa.table([pa.array([key[0].as_py()] * buckets, pa.int32()), pa.array(group_keys(buckets)), *(pa.array(x, pa.binary()) for x in out)], names=["batch", "bucket", *_ASKED])

    return run


def failing_mass(counts: np.ndarray) -> np.ndarray:
    """For each m of GRID, the mass that the failure arcs of states seen `counts` times get, a training token at a time, its own occurrence left out."""
    seen, n = np.unique(counts[counts > 0], return_counts=True)
    seen, n = seen.astype(np.float64), n.astype(np.float64)
    return np.array([float((n * seen * (m / (seen - 1 + m))).sum()) for m in GRID])


def fitted(mass: np.ndarray, once: float) -> float:
    """The m whose failing mass is `once`, between the values of GRID by its logarithm; the nearest of them beyond."""
    return float(2.0 ** np.interp(once, mass, np.log2(GRID)))


def _sum_bucket(key: tuple, table: pa.Table) -> pa.Table:
    """Total training counts of one bucket's n-grams, for each batch in the order it asked, and the bucket's part of the statistics."""
    del key
    answers, counts, mass = [], [], []
    for order in range(1, ORDER + 1):
        k = [_keys(x.as_buffer()) for x in table.column(f"keys{order}")]
        edge = np.concatenate([[0], np.cumsum([len(x) for x in k])])
        c = np.concatenate([_numbers(x.as_buffer()) for x in table.column(f"counts{order}")])
        distinct, at = np.unique(np.concatenate(k), return_inverse=True)
        total = np.bincount(at, c, len(distinct)).astype(np.int64)
        del k, c, distinct
        if order == 1:
            counts = [int(total.sum()), int((total > 0).sum()), int((total == 1).sum()), int((total == 2).sum())]
        else:
            counts.append(int((total == 1).sum()))
        if order < ORDER:
            mass.append(failing_mass(total))
        answers.append([_planes(total[at[a:b]]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)])
        del at, total
    stats = np.array(counts, np.float64).tobytes() + np.concatenate(mass).tobytes()
    K.trim()
    return pa.table([table.column("batch"), table.column("bucket"), *(pa.array(x, pa.binary()) for x in answers), pa.array([stats] * table.num_rows, pa.binary())], names=["batch", "bucket", *_TOTALS, "stats"])


class Automaton:
    """The part of the automaton that some texts reach: states, failure arcs and arcs as arrays.

    counts[k - 1]: training counts of the distinct n-grams of k tokens. grams[k - 1]: which
    of them ends at each token of the texts, whose first tokens are at start. State 0 is the
    root; the n-grams of one and of two tokens follow, and the two marks before a text.
    `texts` is how many texts were learned. stats: tokens, types, words seen once and twice,
    bigrams and trigrams seen once; mass: failing mass by order and GRID.
    """

    def __init__(self, counts: list[np.ndarray], grams: list[np.ndarray], start: np.ndarray, texts: int, stats: np.ndarray, mass: np.ndarray):
        n, types, once, twice = stats[0], stats[1], stats[2], stats[3]
        discount = once / (once + 2 * twice) if once and twice else 0.5
        unseen = discount * types / n if types else 1.0
        self.counts, self.grams, self.start = counts, grams, start
        self.m = [fitted(mass[k], stats[4 + k]) for k in range(ORDER - 1)]
        words, pairs = len(counts[0]), len(counts[1])
        self.of_word, self.of_pair, self.mark = 1, 1 + words, 1 + words + pairs  # first states of each kind
        # States: how often each was reached, and its failure arc.
        self.reached = np.concatenate([[0], counts[0], counts[1], [texts, texts]]).astype(np.int64)
        self.fail_to = np.zeros(len(self.reached), np.int64)
        last = np.empty(pairs, np.int64)
        last[grams[1]] = grams[0]  # the word that each bigram ends with
        self.fail_to[self.of_pair : self.mark] = self.of_word + last
        self.fail_to[self.mark + 1] = self.mark
        m = np.full(len(self.reached), self.m[0])
        m[self.of_pair : self.mark], m[self.mark + 1] = self.m[1], self.m[1]
        with np.errstate(divide="ignore"):
            self.fail_weight = np.log10(m / (self.reached + m))
        # Arcs of the root; then those of longer histories, over their shorter ones.
        root = np.where(counts[0] > 0, (counts[0] - discount) / max(n, 1), unseen)
        self.arcs = [np.log10(root)]
        lower, token_p = root, root[grams[0]]
        for k in range(1, ORDER):
            history = self.reached[self.history(k)]
            p_here = (counts[k][grams[k]] + self.m[k - 1] * token_p) / (history + self.m[k - 1])
            p = np.empty(len(counts[k]))
            p[grams[k]] = np.where(history > 0, p_here, token_p)
            lower, token_p = p, p[grams[k]]
            with np.errstate(divide="ignore"):
                self.arcs.append(np.log10(lower))

    def history(self, k: int) -> np.ndarray:
        """The state that a k-token history before each token names, whether or not training reached it."""
        out = np.empty(len(self.grams[0]), np.int64)
        out[1:] = (self.of_word if k == 1 else self.of_pair) + self.grams[k - 1][:-1]
        out[self.start[:-1]] = self.mark + k - 1
        return out

    def traverse(self) -> np.ndarray:
        """The weight that each token adds on one walk from left to right.

        The state carried to a token is the longest history before it that training
        reached; that depends on two tokens only, so the walks of all texts go side by side.
        A state without an arc for the token fails, adding its failure weight, until one has.
        """
        state = self.history(ORDER - 1)
        for _ in range(ORDER - 1):
            state = np.where(self.reached[state] > 0, state, self.fail_to[state])
        added = np.zeros(len(state))
        length = np.where(state == 0, 0, np.where((state < self.of_pair) | (state == self.mark), 1, 2))
        for k in range(ORDER - 1, -1, -1):
            here = np.flatnonzero(length == k)
            seen = self.counts[k][self.grams[k][here]] > 0 if k else np.ones(len(here), bool)
            hit, miss = here[seen], here[~seen]
            added[hit] += self.arcs[k][self.grams[k][hit]]
            added[miss] += self.fail_weight[state[miss]]
            state[miss] = self.fail_to[state[miss]]
            length[miss] = k - 1
        return added


def _in_order(answers: pa.Table, buckets: int) -> pa.Table:
    """A batch's answers in the order of the hash ranges, one of each bucket."""
    keys = answers.column("bucket").to_numpy()
    by_key = np.argsort(keys)
    return answers.take(pa.array(by_key[np.searchsorted(keys[by_key], group_keys(buckets))]))


def _totals(answers: pa.Table, column: str) -> np.ndarray:
    return np.concatenate([_numbers(x.as_buffer()) for x in answers.column(column)]).astype(np.int64)


def _score(buckets: int, bits: int, id_name: str):
    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        del key
        answers = _in_order(answers, buckets)
        docs, texts, train = _unpacked(docs)
        _, start, asked = _asked(texts, train, bits)
        del texts
        end = np.searchsorted(asked[0][1], _END)
        has_end = end < len(asked[0][1])
        grams = [a[2] for a in asked]
        del asked
        counts = [_totals(answers, c) for c in _TOTALS]
        stats = sum(np.frombuffer(x.as_buffer(), np.float64) for x in answers.column("stats"))
        n, v = int(stats[0]), int(stats[1])
        learned = int(counts[0][end]) if has_end else 0  # each text learned has one end token
        weights = Automaton(counts, grams, start, learned, stats[:_COUNTS], stats[_COUNTS:].reshape(ORDER - 1, -1)).traverse()
        c = counts[0][grams[0]]
        base = np.log10((c + 1.0) / (n + 1 * (v + 1)))
        at = start[:-1]
        add = lambda x: np.add.reduceat(x, at)  # noqa: E731  every text has its end token, so no piece is empty
        K.trim()
        return pa.table([docs.column(id_name), pa.array(~train), pa.array(np.diff(start), pa.int64()), pa.array(add((c > 0).astype(np.int64))), pa.array(np.full(len(at), n), pa.int64()), pa.array(add(base)), pa.array(add(weights))], names=[id_name, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """Score every text with a model learned from those whose crc32(id as text) mod folds is not held_out.

    Tokens: runs of characters other than U+0020 and U+0009..U+000D, A-Z in lower case, then
    one end token. Returns id_col, held_out, n_tokens, n_known (tokens seen in training),
    train_tokens, base_score (add-one unigram log10 probability) and score (the automaton's
    log10 probability). A null or wordless text is its end token only. A null id learns as
    the empty string does. Equal rows are scored alike, each for itself. With nothing to
    learn from, every token has weight 0 at the root. Other columns play no part.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n_batches, n_buckets, bits = pieces(source, BATCH_BYTES), pieces(source, BUCKET_BYTES), key_bits(input_bytes(source))
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds))
    key = F.xxhash64("doc_id", "text")
    kind = source.schema["doc_id"].dataType.simpleString()
    rows = source.select(key.alias("row_key"), "doc_id", (fold != held_out).alias("train"), "text")
    # As many partitions as groups, one in each (group_keys), so that a task's work does not grow with the input.
    packed = rows.mapInArrow(_pack(n_batches), f"batch int, row_key long, doc_id {kind}, train boolean, packed binary").repartition(n_batches, "batch")
    binaries = lambda names: ", ".join(f"{c} binary" for c in names)
    asked = packed.groupBy("batch").applyInArrow(_ask(n_buckets, bits), f"batch int, bucket int, {binaries(_ASKED)}").repartition(n_buckets, "bucket")
    answers = asked.groupBy("bucket").applyInArrow(_sum_bucket, f"batch int, bucket int, {binaries([*_TOTALS, 'stats'])}").repartition(n_batches, "batch")
    out = packed.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_score(n_buckets, bits, "doc_id"), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("doc_id", id_col)
