"""Exact top-k inner-product search with block-at-a-time pruning.

Vectors are dealt to groups along the pivots nearest to them, so that a group holds vectors
that lie together; a pivot with many vectors fills several groups, in which a hash of the id
deals them. Within a group they lie ordered by their two nearest pivots and are cut into
blocks, document ranges with a forward index (the vectors themselves) and each component's
maximum and minimum. For a query, a block's bound is the sum over components of the larger of
query * maximum and query * minimum. A query visits a group's blocks in descending order of
bound and stops when the bound falls below its kth score, or below its floor: its kth score
among the sample, which comes with it to every group, so that groups far from it score no
block. Equal bounds are visited, for ties. Queries travel in blocks too, so a task holds one
group and one block of queries. The k best of each group merge to the k best of all.

Pivots and floors come from a bounded sample (SAMPLE vectors). They order the vectors and
skip blocks: results are exact whatever they are. Where vectors have no clusters (random
directions in many dimensions) no bound falls below the kth score, and all blocks are scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import cut, pieces

TOP, EVERY, SCALE = 10, 100, 1024
SAMPLE, PIVOTS, BLOCK = 4096, 48, 64
GROUP_BYTES, QUERIES = 4 << 20, 4096
_SAFE = 1 << 53


def _pivots(sample: np.ndarray, n: int, rounds: int = 6) -> np.ndarray:
    """Centres of the sample by a few k-means rounds from evenly spaced starts."""
    centres = sample[:: max(1, len(sample) // n)][:n].astype(np.float64)
    for _ in range(rounds):
        near = (sample @ centres.T - (centres**2).sum(1) / 2).argmax(1)
        for c in range(len(centres)):
            mine = sample[near == c]
            if len(mine):
                centres[c] = mine.mean(0)
    return centres


def _matrix(blobs, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.int64).reshape(-1, dim)


class Sample:
    """Some of the vectors (those of the commonest length) with their ids, and pivots among them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors, self.dim = ids, vectors, vectors.shape[1]
        self.pivots = _pivots(vectors.astype(np.float64), PIVOTS) if len(vectors) else np.zeros((0, self.dim))
        self.half = (self.pivots**2).sum(1) / 2
        near = self.nearest(vectors, 1)[:, 0] if len(vectors) else np.zeros(0, np.int64)
        share = np.bincount(near, minlength=len(self.pivots)) + 0.5
        self.upto = np.concatenate([[0.0], np.cumsum(share) / share.sum()]) if len(self.pivots) else np.array([0.0, 1.0])

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest pivots of each vector."""
        if x.shape[1] != self.dim or not len(self.pivots):
            return np.zeros((len(x), n), np.int64)
        return np.argsort(self.half - x.astype(np.float64) @ self.pivots.T, axis=1, kind="stable")[:, np.minimum(np.arange(n), len(self.pivots) - 1)]

    def home(self, ids: np.ndarray, x: np.ndarray, groups: int) -> np.ndarray:
        """The group of each vector: groups share the pivots out by their part of the sample."""
        dealt = (K.mix(ids.view(np.uint64)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
        if x.shape[1] == self.dim and len(self.pivots):
            near = self.nearest(x, 1)[:, 0]
            dealt = self.upto[near] + (self.upto[near + 1] - self.upto[near]) * dealt
        return np.minimum((dealt * groups).astype(np.int64), groups - 1)

    def floors(self, ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
        """Each query's kth score among the sample, itself left out; the least integer where there are fewer."""
        none = np.iinfo(np.int64).min
        if x.shape[1] != self.dim or len(self.vectors) < k:
            return np.full(len(x), none)
        scores = _product(x, self.vectors)
        scores[ids[:, None] == self.ids[None, :]] = none
        return np.partition(scores, len(self.vectors) - k, axis=1)[:, len(self.vectors) - k]


def _vectors(column: pa.Array, rows: int) -> np.ndarray:
    return np.array(column.flatten()).astype(np.int64).reshape(rows, -1)


def _deal(sample: Sample, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, q, dim = K.ids_of(batch, "vec_id").to_numpy(), K.ids_of(batch, "q"), K.ids_of(batch, "dim").to_numpy()
            home = np.zeros(len(ids), np.int32)
            for n in np.unique(dim):
                at = np.flatnonzero(dim == n)
                home[at] = sample.home(ids[at], _vectors(q.take(pa.array(at)), len(at)), groups)
            yield pa.RecordBatch.from_arrays([pa.array(home), K.ids_of(batch, "dim"), K.ids_of(batch, "vec_id"), q], names=["grp", "dim", "vec_id", "q"])

    return run


def _pack(sample: Sample, k: int = 0):
    """One row per group and length: ids, vectors and, for queries (k over 0), their floors."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        x = _vectors(table.column("q").combine_chunks(), len(ids))
        near = sample.nearest(x, 2)
        order = np.lexsort((ids, near[:, 1], near[:, 0]))
        ids, x = ids[order], x[order]
        out = {"grp": pa.array([key[0].as_py()], pa.int32()), "dim": pa.array([x.shape[1]], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "vectors": pa.array([x.tobytes()], pa.binary())}
        return pa.table(out | ({"floors": pa.array([sample.floors(ids, x, k).tobytes()], pa.binary())} if k else {}))

    return run


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in whole numbers; in floating point where every sum is exact there."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < _SAFE:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def search(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, block: int = BLOCK, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best (scores, ids) of each query in one group, and how many blocks were scored for all queries.

    Where floor has a query's kth score among other candidates, blocks bound to stay below it
    are left out. Places without a candidate hold the least integer.
    """
    none = np.iinfo(np.int64).min
    score, best = np.full((len(queries), k), none), np.full((len(queries), k), np.iinfo(np.int64).max)
    floor = np.full(len(queries), none) if floor is None else floor
    starts = np.arange(0, len(vectors), block)
    high, low = np.maximum.reduceat(vectors, starts), np.minimum.reduceat(vectors, starts)
    bound = _product(np.maximum(queries, 0), high) + _product(np.minimum(queries, 0), low)
    order = np.argsort(-bound, axis=1, kind="stable")
    visited = 0
    active = np.arange(len(queries))
    for r in range(len(starts)):
        at = order[active, r]
        go = bound[active, at] >= np.maximum(score[active, k - 1], floor[active])
        active, at = active[go], at[go]
        if not len(active):
            break
        for b in np.unique(at):
            who = active[at == b]
            visited += len(who)
            j = slice(int(starts[b]), int(starts[b]) + block)
            s = _product(queries[who], vectors[j])
            s[query_ids[who, None] == ids[None, j]] = none
            s = np.concatenate([score[who], s], 1)
            i = np.concatenate([best[who], np.broadcast_to(ids[j], (len(who), len(ids[j])))], 1)
            i = np.where(s == none, np.iinfo(np.int64).max, i)
            top = np.lexsort((i, -s.astype(np.float64) if np.abs(s[s != none]).max(initial=0) < _SAFE else np.where(s == none, np.iinfo(np.int64).max, -s)), axis=1)[:, :k]
            score[who], best[who] = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
    return score, best, visited


def _search_groups(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                dim, ids, vectors, query_ids, queries, floors = (K.ids_of(batch, c)[row].as_py() for c in ("dim", "ids", "vectors", "query_ids", "queries", "floors"))
                own = np.frombuffer(query_ids, np.int64)
                score, best, _ = search(_matrix([queries], dim), own, _matrix([vectors], dim), np.frombuffer(ids, np.int64), k, floor=np.frombuffer(floors, np.int64))
                q, r = np.nonzero(score != np.iinfo(np.int64).min)
                yield pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(best[q, r]), pa.array(score[q, r])], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = TOP, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """The k highest inner products of each query with all other vectors, over floor(scale * component).

    Queries are the rows whose id is divisible by `every`. Returns query_id, rank (from 1),
    vec_id, score, ties to the smaller vec_id; all candidates if there are fewer than k.
    Vectors that are null, empty or hold a null or non-finite component take no part, nor
    do rows with a null id. Rows that repeat an id are candidates each, and no row is a
    candidate for a query of its own id; of queries that repeat an id, the least vector is searched.
    Vectors of different lengths are not compared. Other columns play no part.
    """
    comps = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    sound = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.coalesce(sound, F.lit(False)) & (F.size(vector_col) > 0)).select(F.col(id_col).cast("long").alias("vec_id"), comps.alias("q")).withColumn("dim", F.size("q"))
    groups = pieces(vectors.select(id_col, vector_col), GROUP_BYTES)
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    dims = some.column("dim").to_numpy()
    width = int(np.bincount(dims).argmax()) if len(dims) else 0
    some = some.filter(pa.array(dims == width))
    sample = Sample(some.column("vec_id").to_numpy(), _vectors(some.column("q").combine_chunks(), some.num_rows) if some.num_rows else np.zeros((0, width), np.int64))
    dealt = "grp int, dim int, vec_id long, q array<long>"
    cols = rows.select("vec_id", "q", "dim")
    packed = cols.mapInArrow(_deal(sample, groups), dealt).repartition(groups, "grp", "dim").groupBy("grp", "dim").applyInArrow(_pack(sample), "grp int, dim int, ids binary, vectors binary")
    asked = cols.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("q").alias("q")).withColumn("dim", F.size("q"))
    blocks = max(1, groups * 10_000 // every // QUERIES + 1)
    asked = asked.mapInArrow(_deal(sample, blocks), dealt).groupBy("grp", "dim").applyInArrow(_pack(sample, k), "grp int, dim int, ids binary, vectors binary, floors binary")
    sent = cut(asked, "queries").select("dim", F.col("ids").alias("query_ids"), F.col("vectors").alias("queries"), "floors", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"))
    found = packed.join(sent, ["grp", "dim"]).select("dim", "ids", "vectors", "query_ids", "queries", "floors").mapInArrow(_search_groups(k), "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
