"""Exact n-gram Jaccard self-join by vertical partitioning.

The n-gram order is cut into fragments (ranges of the n-gram hash). Each fragment sees, of
every set, only the n-grams in its range, and counts for itself:

1. document frequencies, so that n-grams of one set only drop out, and how many n-grams of
   each set are shared at all. Summed over fragments, a set with fewer shared n-grams than
   the threshold asks of any partner leaves the job: in most corpora nearly all sets do.
2. partial overlaps of candidate pairs, which are summed per pair.

Candidates come from prefixes in the order rarest first, after which two sets within the
threshold must share an n-gram. Groups of near copies never become all their pairs: sets
are first linked to leaders (the least set of a min-hash group, then the nearest set of the
largest component met), linked sets contract to components, and only prefix n-grams that
join different components make pairs. Equal sets
are one class from the start. No link between different sets is lost: a pair is skipped
only if a bound proves it below the threshold or it is known to be connected.

An n-gram or min-hash value that very many sets share is split: min-hash groups have leaders
by parts first, which then have one leader, and the k sets of an n-gram are dealt to about
sqrt(k / 64) parts, each pair of which is a group of its own.

Sets of 64-bit hashes stand for the sets of n-grams. A fragment's number is their leading
bits; within it the last 48 are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import cut, group_keys, pieces, small_batches
from .components import components

WORDS, NUM, DEN = 5, 3, 4  # shingles of 5 words; similarity of 3/4 or more
FRAGMENT_BYTES = 6 << 20  # input bytes whose n-grams one fragment counts
PARTS = 4  # ranges of the order (by its two leading bits) in which candidate pairs are counted
LEADERS = 4  # min-hash groups per set
STARS = 2  # rounds that link sets to the largest component they meet, before the rest is compared in pairs
BITMAP = 8  # 64-bit words of a set's parity bitmap
SALTS = 16  # parts of a min-hash group
SPLIT = 64  # an n-gram's k sets are dealt to sqrt(k / SPLIT) parts
_LOW48 = np.uint64((1 << 48) - 1)


def shingle_sets(column, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashes of each text's n-word shingles, sorted within a text; first index of each text)."""
    h, first, _, _ = K.words(column, lower=True)
    length = np.diff(first)
    grams = K.windows(h, n)
    ok = K.inside(first, len(h), n)
    own = K.owner(first)
    doc, gram = own[: len(grams)][ok], grams[ok]
    short = np.flatnonzero((length > 0) & (length < n))
    if len(short):  # fewer words than n: the whole sequence is the one shingle
        whole = np.full(len(short), 0x51ED270B, np.uint64)
        for j in range(n - 1):
            at = np.minimum(first[short] + j, len(h) - 1)
            whole = np.where(j < length[short], K.mix(whole * np.uint64(31) + h[at]), whole)
        doc, gram = np.concatenate([doc, short]), np.concatenate([gram, K.mix(whole + length[short].astype(np.uint64))])
    order = np.lexsort((gram, doc))
    doc, gram = doc[order], gram[order]
    if len(gram):
        keep = np.ones(len(gram), bool)
        keep[1:] = (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])
        doc, gram = doc[keep], gram[keep]
    return gram, np.searchsorted(doc, np.arange(len(length) + 1), "left")


def set_keys(gram: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set (0: the empty set); equal sets have equal keys."""
    sums = np.zeros(len(gram) + 1, np.uint64)
    np.cumsum(K.mix(gram + np.uint64(0xA5A5)), out=sums[1:])
    n = np.diff(first).astype(np.uint64)
    key = K.mix(sums[first[1:]] - sums[first[:-1]] + n * np.uint64(0x9E3779B97F4A7C15))
    return np.where(n == 0, np.uint64(0), np.where(key == 0, np.uint64(1), key))


def _profile(n: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                gram, first = shingle_sets(K.ids_of(part, "text"), n)
                yield pa.RecordBatch.from_arrays([*(K.ids_of(part, c) for c in names), pa.array(np.diff(first), pa.int64()), pa.array(set_keys(gram, first).view(np.int64))], names=[*names, "n_shingles", "set_key"])

    return run


def _to_fragments(n: int, bits: int):
    """Deal the n-grams of each distinct set of a batch to 2**bits fragments: one row per fragment and batch."""
    hold = max(400_000, 60 << bits)  # n-grams of a batch: enough for rows of some size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        dealt = group_keys(1 << bits).tolist()

        def flush() -> Iterator[pa.RecordBatch]:
            keys, sizes = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            grams = np.concatenate([x[2] for x in held])
            own = np.repeat(np.arange(len(keys)), sizes)
            at = (grams >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(grams), np.int64)
            order = np.lexsort((own, at))
            at, own, grams = at[order], own[order], grams[order] & _LOW48
            there = np.unique(at)
            edge = np.append(np.searchsorted(at, there), len(at))
            low, high = grams.astype(np.uint32), (grams >> np.uint64(32)).astype(np.uint16)
            out: list[list] = [[] for _ in range(6)]
            for f, lo, hi in zip(there.tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                start = np.flatnonzero(np.concatenate([[True], own[lo + 1 : hi] != own[lo : hi - 1]]))
                mine = own[lo:hi][start]
                for x, v in zip(out, (dealt[f], keys[mine].tobytes(), sizes[mine].astype(np.uint32).tobytes(), np.diff(np.append(start, hi - lo)).astype(np.uint32).tobytes(), low[lo:hi].tobytes(), high[lo:hi].tobytes()), strict=True):
                    x.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])], names=["fragment", "keys", "sizes", "counts", "low", "high"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                gram, first = shingle_sets(K.ids_of(batch.slice(lo, 500), "text"), n)
                key, sizes = set_keys(gram, first), np.diff(first)
                _, once = np.unique(key, return_index=True)  # copies within the batch go once
                pick = np.zeros(len(key), bool)
                pick[once] = True
                pick &= sizes > 0
                held.append((key[pick], sizes[pick], gram[np.repeat(pick, sizes)]))
                size += int(sizes[pick].sum())
                if size >= hold:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()
        held.clear()
        K.trim()

    return run


def _count_fragment(bits: int):
    """Of one fragment: each set's n-grams that another set has too, with their document frequencies.

    The answers go by set, in one row for each of 2**bits ranges of set keys, their homes.
    """
    inner = np.uint64((1 << min(48, 64 - bits)) - 1)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        dealt = group_keys(1 << bits)
        fragment = int(np.flatnonzero(dealt == key[0].as_py())[0])
        kinds = (("keys", np.uint64), ("sizes", np.uint32), ("counts", np.uint32), ("low", np.uint32), ("high", np.uint16))
        keys, sizes, counts, low, high = (np.concatenate([np.frombuffer(x.as_buffer(), t) for x in table.column(c)]) for c, t in kinds)
        gram = low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)
        del low, high
        names, at, of = np.unique(keys, return_index=True, return_inverse=True)
        row = np.repeat(np.arange(len(keys)), counts)
        once = at[of[row]] == row  # a set that came from several batches counts once
        own, gram = of[row[once]], gram[once]
        del row, once
        order = np.argsort(gram, kind="stable")
        gram, own = gram[order], own[order]
        del order
        edge = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        df = np.diff(np.append(edge, len(gram)))
        df = np.repeat(df, df)
        keep = df > 1
        gram, own, df = gram[keep], own[keep], df[keep]
        order = np.argsort(own, kind="stable")
        packed = np.empty(len(order), _PACKED)
        packed["g"], packed["f"] = gram[order] & inner | np.uint64(fragment << 64 - bits if bits else 0), np.minimum(df[order], 0xFFFFFFFF)
        sets, n = np.unique(own, return_counts=True)
        home = (names[sets] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(sets), np.int64)
        there = np.unique(home)  # set keys ascend, and so do homes
        bounds = np.append(np.searchsorted(home, there), len(home))
        start = np.concatenate([[0], np.cumsum(n)])
        out: list[list] = [[] for _ in range(5)]
        for h, lo, hi in zip(there.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            mine = sets[lo:hi]
            for x, v in zip(out, (int(dealt[h]), names[mine].tobytes(), sizes[at[mine]].tobytes(), n[lo:hi].astype(np.uint32).tobytes(), packed[start[lo] : start[hi]].tobytes()), strict=True):
                x.append(v)
        del gram, own, df, packed, order
        K.trim()
        return pa.table([pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])], names=["home", "keys", "sizes", "counts", "grams"])

    return run


_PACKED = np.dtype([("g", "<u8"), ("f", "<u4")])
_SETS = "set_key long, n long, head binary, bits binary, m long, leads array<long>, parts array<binary>"


def _gather_sets(num: int, den: int):
    """Sum the fragments' counts by set; keep sets with enough shared n-grams for any partner.

    Those get their n-grams rarest first, hence a prefix, a parity bitmap and min-hash
    leader keys, and are cut in PARTS ranges of the n-gram order.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        del key
        keys, sizes, counts, packed = (np.concatenate([np.frombuffer(x.as_buffer(), t) for x in table.column(c)]) for c, t in (("keys", np.uint64), ("sizes", np.uint32), ("counts", np.uint32), ("grams", _PACKED)))
        names, at, of = np.unique(keys, return_index=True, return_inverse=True)
        shared = np.bincount(of, counts, len(names)).astype(np.int64)
        n_of = sizes[at].astype(np.int64)
        alive = den * shared >= num * n_of
        own = np.repeat(of, counts)
        keep = alive[own]
        own, packed = own[keep], packed[keep]
        packed = packed[np.lexsort((packed["g"], own))]
        rows: list[list] = [[] for _ in range(7)]
        end = 0
        for i in np.flatnonzero(alive).tolist():
            start, end = end, end + int(shared[i])
            g, f, n = packed["g"][start:end], packed["f"][start:end], int(n_of[i])
            prefix = n - -(-num * n // den) + 1 - (n - len(g))  # n-grams of no other set come first and are gone
            head = g[np.argsort(f, kind="stable")[:prefix]]
            bits, mixed = np.zeros(BITMAP, np.uint64), K.mix(g)
            np.bitwise_xor.at(bits, (mixed & np.uint64(BITMAP - 1)).astype(np.int64), np.uint64(1) << (mixed >> np.uint64(8) & np.uint64(63)))
            leads = [int((mixed * np.uint64(2 * j + 1)).min().view(np.int64)) for j in range(LEADERS)]
            edge = np.searchsorted(g >> np.uint64(62), np.arange(PARTS + 1))
            for v, y in zip((int(names[i].view(np.int64)), n, head.tobytes(), bits.tobytes(), len(g), leads, [g[edge[j] : edge[j + 1]].tobytes() for j in range(PARTS)]), rows, strict=True):
                y.append(v)
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary()))
        return pa.table([pa.array(x, t) for x, t in zip(rows, kinds, strict=True)], names=["set_key", "n", "head", "bits", "m", "leads", "parts"])

    return run


def _explode_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        heads = [np.frombuffer(x, np.int64) for x in K.ids_of(batch, "head").to_pylist()]
        n = [len(x) for x in heads]
        if sum(n):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(heads)), *(pa.array(np.repeat(K.ids_of(batch, c).to_numpy(), n)) for c in ("set_key", "n", "label"))], names=["gram", "set_key", "n", "label"])


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial overlap of each candidate pair within one part of the n-gram order."""
    for batch in batches:
        x, y = K.ids_of(batch, "x"), K.ids_of(batch, "y")
        counts = [len(np.intersect1d(np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64), True)) for p, q in zip(x, y, strict=True)]
        yield pa.RecordBatch.from_arrays([K.ids_of(batch, "a"), K.ids_of(batch, "b"), K.ids_of(batch, "need"), pa.array(counts, pa.int32())], names=["a", "b", "need", "shared"])


def _linked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs (a, b), those within the threshold: partial overlaps by part, summed per pair."""
    side = sets.select("set_key", "n", F.posexplode("parts").alias("part", "piece")).filter(F.length("piece") > 0)
    a = side.select(F.col("set_key").alias("a"), F.col("n").alias("na"), "part", F.col("piece").alias("x"))
    b = side.select(F.col("set_key").alias("b"), F.col("n").alias("nb"), "part", F.col("piece").alias("y"))
    # overlap / (na + nb - overlap) >= num / den
    need = (num * (F.col("na") + F.col("nb"))).alias("need")
    both = pairs.join(a, "a").join(b, ["b", "part"]).select("a", "b", need, "x", "y")
    partial = both.mapInArrow(_overlap, "a long, b long, need long, shared int")
    return partial.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("need").alias("need")).filter((num + den) * F.col("shared") >= F.col("need")).select("a", "b")


def _leader_pairs(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Each set with the least set of its part of each of its min-hash groups, and those with the least of the whole group."""
    salt = F.pmod(F.xxhash64("set_key"), F.lit(SALTS)).alias("salt")
    keyed = sets.select("set_key", "n", salt, F.posexplode("leads").alias("j", "lead"))
    parts = keyed.groupBy("j", "lead", "salt").agg(F.min(F.struct("n", "set_key")).alias("m"), F.count("*").alias("size"))
    tops = parts.groupBy("j", "lead").agg(F.min("m").alias("m"), F.count("*").alias("size")).filter("size > 1").select("j", "lead", "m")
    in_part = keyed.join(parts.filter("size > 1").select("j", "lead", "salt", "m"), ["j", "lead", "salt"])
    of_tops = parts.select("j", "lead", "m.set_key", "m.n").join(tops, ["j", "lead"])
    pairs = in_part.select("set_key", "n", "m").unionByName(of_tops.select("set_key", "n", "m"))
    pairs = pairs.filter((F.col("m.set_key") != F.col("set_key")) & (num * F.col("n") <= den * F.col("m.n")))
    return pairs.select(F.greatest("set_key", "m.set_key").alias("a"), F.least("set_key", "m.set_key").alias("b")).distinct()


def _by_gram(make):
    """mapInArrow over rows sorted by (gram, p, q): make(whole groups' columns, their bounds) -> pairs (a, b)."""

    def key(table: pa.Table | pa.RecordBatch) -> np.ndarray:
        return np.stack([table.column(table.schema.get_field_index(c)).to_numpy() for c in ("gram", "p", "q")], 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the group that is not yet over
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = key(batch)
            same = (keys == keys[-1]).all(1)
            last = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if last or (held and (key(held[-1])[-1] != keys[-1]).any()):
                yield from done(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield from done(pa.Table.from_batches(held))

    def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = key(table)
        sets, n, m, label, part = (table.column(c).to_numpy() for c in ("set_key", "n", "m", "label", "part"))
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(len(sets), BITMAP)
        order = np.lexsort((sets, n, keys[:, 2], keys[:, 1], keys[:, 0]))
        keys = keys[order]
        cols = {"set_key": sets[order], "n": n[order], "m": m[order], "label": label[order], "part": part[order], "alone": keys[:, 1] == keys[:, 2], "bits": bits[order]}
        bounds = np.append(np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])), len(keys))
        a, b = make(cols, bounds)
        a, b = np.maximum(a, b), np.minimum(a, b)
        if len(a):
            _, once = np.unique(K.mix(a.view(np.uint64)) ^ b.view(np.uint64), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(a[once]), pa.array(b[once])], names=["a", "b"])

    return run


def _near(x: dict, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which of the pairs (i, j) of different components the size and bitmap bounds let pass."""
    n, m, bits = x["n"], x["m"], x["bits"]
    apart = np.bitwise_count(bits[i] ^ bits[j]).sum(-1).astype(np.int64)
    ok = (x["label"][i] != x["label"][j]) & (num * np.maximum(n[i], n[j]) <= den * np.minimum(n[i], n[j]))
    ok &= x["alone"][i] | (x["part"][i] != x["part"][j])  # two parts together: only pairs between them
    return ok & ((num + den) * (m[i] + m[j] - apart) >= 2 * num * (n[i] + n[j]))  # overlap <= (m_i + m_j - apart) / 2


def _star_pairs(num: int, den: int, tries: int = 64):
    """Of each n-gram's sets, those outside its most frequent component with the nearest of some sets of that component."""

    def make(x: dict, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = [], []
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            labels, first, n = np.unique(x["label"][lo:hi], return_index=True, return_counts=True)
            if len(labels) < 2:
                continue
            main = x["label"][lo:hi] == labels[np.lexsort((first, -n))[0]]
            core, others = lo + np.flatnonzero(main), lo + np.flatnonzero(~main)
            core = core[:: -(-len(core) // tries)]
            for k in range(0, len(others), 4096):
                i = others[k : k + 4096, None]
                ok = _near(x, i, core[None, :], num, den)
                apart = np.bitwise_count(x["bits"][i] ^ x["bits"][core[None, :]]).sum(-1).astype(np.int64)
                best = np.where(ok, apart, 1 << 20).argmin(1)
                hit = ok.any(1)
                left.append(x["set_key"][i[hit, 0]])
                right.append(x["set_key"][core[best[hit]]])
        return tuple(np.concatenate(v) if v else np.zeros(0, np.int64) for v in (left, right))

    return _by_gram(make)


def _cross_pairs(num: int, den: int):
    """Of each n-gram's sets, all pairs of different components that the bounds let pass."""

    def make(x: dict, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = [], []

        def add(i: np.ndarray, j: np.ndarray) -> None:
            for k in range(0, len(i), 1 << 18):
                p, q = i[k : k + (1 << 18)], j[k : k + (1 << 18)]
                ok = _near(x, p, q, num, den)
                left.append(x["set_key"][p[ok]])
                right.append(x["set_key"][q[ok]])

        size = np.diff(bounds)
        end = np.repeat(bounds[1:], size)
        short = np.repeat(size <= 64, size)
        for d in range(1, min(64, int(size.max(initial=0)))):  # short lists, all together: every pair d places apart
            i = np.flatnonzero(short & (np.arange(len(end)) + d < end))
            if not len(i):
                break
            add(i, i + d)
        for lo, hi in zip(bounds[:-1][size > 64].tolist(), bounds[1:][size > 64].tolist(), strict=True):
            n = x["n"][lo:hi]
            last = np.searchsorted(n * num, n * den, "right")  # n ascends: who may be a partner by size
            for i in range(hi - lo - 1):
                add(np.full(max(0, int(last[i]) - i - 1), lo + i), np.arange(lo + i + 1, lo + int(last[i])))
        return tuple(np.concatenate(v) if v else np.zeros(0, np.int64) for v in (left, right))

    return _by_gram(make)


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """labels (node, label) after more links: only the links between components take part."""
    if labels is None:
        return cut(components(links), "labels")
    of = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"{side}_label"))
    named = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    met = components(named.select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")))
    met = cut(met, "met")
    moved = labels.join(met.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    new = met.join(labels.select("node"), "node", "left_anti").select("node", "label")
    return cut(moved.unionByName(new), "labels")


def _meet(sets: DataFrame, labels: DataFrame, make, both: bool) -> DataFrame:
    """Pairs that `make` forms of sets of different components that share a prefix n-gram.

    The sets of an n-gram come in parts: each for itself or, with `both`, each two of them.
    """
    labelled = cut(sets.select("set_key", "n", "head").join(labels.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("label", F.coalesce("label", "set_key")), "labelled")
    posts = labelled.mapInArrow(_explode_heads, "gram long, set_key long, n long, label long")
    mixed = posts.groupBy("gram").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("k")).filter("lo <> hi")
    mixed = mixed.select("gram", F.ceil(F.sqrt(F.col("k") / SPLIT)).cast("int").alias("parts"))
    met = posts.join(mixed, "gram").withColumn("part", F.pmod(F.xxhash64("set_key"), F.col("parts")).cast("int"))
    if both:
        other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        met = met.withColumn("other", other).withColumns({"p": F.least("part", "other"), "q": F.greatest("part", "other")}).drop("other")
    else:
        met = met.withColumns({"p": F.col("part"), "q": F.col("part")})
    met = met.drop("parts").join(sets.select("set_key", "bits", "m"), "set_key")
    return met.repartition("gram", "p", "q").sortWithinPartitions("gram", "p", "q").mapInArrow(make, "a long, b long").distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, num: int = NUM, den: int = DEN, row_col: str | None = None) -> DataFrame:
    """Link documents whose sets of `words`-word shingles have Jaccard similarity num/den or more.

    Returns id_col, n_shingles (size of the set), component_id (the smallest id that links
    reach, its own included). Words are runs of characters other than U+0020 and
    U+0009..U+000D, A-Z in lower case. A text with fewer words than `words` has its whole
    sequence as its one shingle. Null or wordless texts have the empty set, link with
    nothing and are their own component. A row with a null id is kept, with a null
    component unless its set links it to others. Repeated ids give a row each. If row_col
    names a column (long), row_key has its values and component a number of the component,
    apart even where rows of equal ids lie in different ones; null for the empty set. Other
    columns of docs play no part, whatever their names.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *([F.col(row_col).alias("row_key")] if row_col else []))
    id_type = source.schema["doc_id"].dataType.simpleString()
    bits = (pieces(source, FRAGMENT_BYTES) - 1).bit_length()
    names = ["doc_id", "row_key"] if row_col else ["doc_id"]
    profile = cut(source.mapInArrow(_profile(words, names), f"doc_id {id_type}, {'row_key long, ' if row_col else ''}n_shingles long, set_key long"), "profile")
    classes = profile.filter("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("least"))

    dealt = source.select("doc_id", "text").mapInArrow(_to_fragments(words, bits), "fragment int, keys binary, sizes binary, counts binary, low binary, high binary")
    shared = dealt.repartition(1 << bits, "fragment").groupBy("fragment").applyInArrow(_count_fragment(bits), "home int, keys binary, sizes binary, counts binary, grams binary")
    sets = cut(shared.repartition(1 << bits, "home").groupBy("home").applyInArrow(_gather_sets(num, den), _SETS), "sets")

    labels = _merged(None, _linked(_leader_pairs(sets, num, den), sets, num, den))
    for _ in range(STARS):
        new = cut(_linked(_meet(sets, labels, _star_pairs(num, den), False), sets, num, den), "links")
        if new.isEmpty():
            break
        labels = _merged(labels, new)
    labels = _merged(labels, _linked(_meet(sets, labels, _cross_pairs(num, den), True), sets, num, den))

    named = classes.join(labels.withColumnRenamed("node", "set_key"), "set_key", "left").select("set_key", "least", F.coalesce("label", "set_key").alias("label"))
    root = named.groupBy("label").agg(F.min("least").alias("component_id"))
    split = F.bitwise_not("label").alias("k")  # as in components: a very large component can be split
    by_set = named.select("set_key", split).join(root.select(split, "component_id"), "k").select("set_key", "component_id", F.col("k").alias("component"))
    out = profile.join(by_set, "set_key", "left")
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), *(["row_key", "component"] if row_col else []))
