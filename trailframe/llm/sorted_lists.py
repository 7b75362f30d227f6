"""Exact top-k by inner product, without random access: each block of vectors has a sorted list for every component; a query reads its
lists from their best ends and keeps lower and upper bounds of all scores, until no outsider can qualify. What is left is resolved."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailframe.llm import common as C
from trailframe.llm import vectors

SCALE, K, EVERY = 256, 5, 50
#: Vectors whose lists are sorted together, and queries that go to all tasks at once; of long vectors fewer, 8 MB of either.
BLOCK, QUERIES = 2048, 8192
#: Reading stops where the candidates left are at most this share of the block, or as many as are wanted. The first depth, as a share of
#: the lists, and by how much it grows.
LEFT, DEPTH, GROWTH = 1 / 4, 1 / 8, 4


class Lists:
    """The sorted lists of a block of vectors (n x d): list (0, i) reads component i upwards, list (1, i) downwards."""

    def __init__(self, x: np.ndarray):
        self.x = x
        up = np.argsort(x, axis=0, kind="stable").T
        self.rows = np.ascontiguousarray(np.stack([up, up[:, ::-1]]).astype(np.int32))
        self.values = self.x.T[np.arange(x.shape[1])[None, :, None], self.rows].astype(np.float64)

    def candidates(self, q: np.ndarray, k: int, bar: float) -> tuple[np.ndarray, int]:
        """Rows that may be among the k best of the block and reach `bar`; all rows that do are among them. And how many entries were
        read. Lists are read to a depth that grows: what isn't seen of a list is worth what was read last at most, and what stands at its
        far end at least. Lower bounds are needed until a `bar` is known from other blocks."""
        n = len(self.x)
        if n <= k:
            return np.arange(n), 0
        used = np.flatnonzero(q)
        side, w = (q[used] > 0).astype(np.int64), q[used].astype(np.float64)
        least = self.values[side, used, n - 1] * w
        slack = 1e-9 * (1 + np.abs(w) @ np.maximum(np.abs(self.values[0, used, 0]), np.abs(self.values[0, used, n - 1])))
        enough, depth = max(k, int(n * LEFT)), max(k, int(n * DEPTH))
        while True:
            depth = min(depth, n)
            seen = self.rows[side, used, :depth].ravel()
            worth = self.values[side, used, :depth] * w[:, None]
            last = worth[:, -1] if depth < n else least
            upper = last.sum() + np.bincount(seen, (worth - last[:, None]).ravel(), n)
            if upper.max() < bar - slack:
                return np.empty(0, np.int64), depth * len(used)
            if bar == -np.inf or depth == n:
                lower = least.sum() + np.bincount(seen, (worth - least[:, None]).ravel(), n)
                reach = max(bar, np.partition(lower, n - k)[n - k])
            else:
                reach = bar
            alive = np.flatnonzero(upper >= reach - slack)
            if len(alive) <= enough or depth == n:
                return alive, depth * len(used)
            depth *= GROWTH


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id; null ids (the largest long) last."""
    if len(scores) > 4 * k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


_NULL = np.iinfo(np.int64).max
_FOUND = "query_no int, query_id long, own long, ids array<long>, scores array<long>"


def _pass(rows: DataFrame, query_ids: list[int], queries: np.ndarray, k: int) -> DataFrame:
    """_FOUND for each query and task: the k best rows among those of the task. The queries, QUERIES at most, go to all tasks."""
    shared = rows.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        qs = shared.value
        top_scores = [np.empty(0, np.int64)] * len(qs)
        top_ids = [np.empty(0, np.int64)] * len(qs)
        for ids, x in vectors.blocks(batches, BLOCK):
            ids = ids.fill_null(_NULL).to_numpy(zero_copy_only=False)
            width = max(x.shape[1], qs.shape[1])
            x, q = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, qs))
            lists = Lists(x)
            for i in range(len(q)):
                bar = top_scores[i][-1] if len(top_scores[i]) == k else -np.inf
                at, _ = lists.candidates(q[i], k, bar)
                if len(at):
                    scores, names = np.r_[top_scores[i], x[at] @ q[i]], np.r_[top_ids[i], ids[at]]
                    at = best(scores, names, k)
                    top_scores[i], top_ids[i] = scores[at], names[at]
        own = (qs * qs).sum(1)
        for a in range(0, len(qs), 1024):
            b = min(a + 1024, len(qs))
            lists_of = [pa.array([x.tolist() for x in top[a:b]], pa.list_(pa.int64())) for top in (top_ids, top_scores)]
            yield pa.RecordBatch.from_arrays([pa.array(range(a, b), pa.int32()), pa.array(query_ids[a:b], pa.int64()), pa.array(own[a:b]), *lists_of], ["query_no", "query_id", "own", "ids", "scores"])

    return rows.mapInArrow(run, _FOUND)


def _query_blocks(queries: DataFrame, most: int, numbers: int = vectors.NUMBERS) -> Iterator[tuple[list[int], np.ndarray]]:
    """Ids and vectors of `most` queries, and `numbers` components, at a time; the driver holds one such block, and what one task has packed,
    at once."""

    def pack(batches):
        for ids, x in vectors.blocks(batches, most, numbers):
            yield pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([x.astype(np.int32).tobytes()], pa.binary()), pa.array([x.shape[1]], pa.int32())], ["ids", "x", "width"])

    held_ids: list[int] = []
    held: list[np.ndarray] = []

    def joined():
        width = max(x.shape[1] for x in held)
        return held_ids, np.concatenate([np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in held])

    for row in queries.mapInArrow(pack, "ids array<long>, x binary, width int").toLocalIterator():
        x = np.frombuffer(row["x"], np.int32).reshape(len(row["ids"]), row["width"]).astype(np.int64)
        widest = max([x.shape[1], *(h.shape[1] for h in held)])
        if held_ids and (len(held_ids) + len(x) > most or (len(held_ids) + len(x)) * widest > numbers):
            yield joined()
            held_ids, held = [], []
        held_ids = held_ids + list(row["ids"])
        held.append(x)
    if held_ids:
        yield joined()


def top_k(rows: DataFrame, queries: DataFrame, k: int = K, most: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of the highest inner product for each query, itself left out; both tables have
    vec_id long and v array<int>, and the queries are among the rows. Ties go to the smaller id, null ids last. Each repeated row is a query
    and a candidate of its own. Missing components of shorter vectors count as 0. No queries or no other rows: no rows.

    A block of `most` queries is broadcast, and the rows are read in place, once for each block. What is shuffled is the k + 1 best of each
    query and task."""
    passes = []
    for ids, block in _query_blocks(queries, most):
        found = _pass(rows, ids, block, k + 1)
        each = found.select("query_no", "query_id", "own", F.inline(F.arrays_zip("ids", "scores")))
        each = each.select("query_no", "query_id", F.nullif("ids", F.lit(_NULL)).alias("vec_id"), F.col("scores").alias("score"), "own")
        order = [F.col("score").desc(), F.col("vec_id").asc_nulls_last()]
        each = each.withColumn("n", F.row_number().over(Window.partitionBy("query_no").orderBy(*order))).where(F.col("n") <= k + 1)
        # of the rows that are like the query itself, one is the query
        like = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own"))
        first = F.min(F.when(like, F.col("n"))).over(Window.partitionBy("query_no"))
        each = each.withColumn("first", first).where("first is null or n <> first")
        each = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_no").orderBy("n"))).where(F.col("rank") <= k)
        passes.append(C.checkpoint(each.select("query_id", "rank", "vec_id", "score")))
    if not passes:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = passes[0]
    for p in passes[1:]:
        out = out.unionByName(p)
    return out


def op12_sorted_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the five best of all vectors for each vector whose id is divisible by 50."""
    rows = vectors.whole(C.read(spark, sf_dir, "embeddings"), SCALE)
    return top_k(rows, rows.where(F.col("vec_id") % EVERY == 0))
