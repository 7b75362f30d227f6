"""Lloyd's rounds by dual trees: a cover tree over each chunk of vectors, built once, meets a cover tree over the centroids, built anew
in each round. Pairs of nodes whose distance bounds show that they can't hold a nearest pair are pruned; leaves are compared exactly."""

from __future__ import annotations

import hashlib
import io
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.llm import common as C
from trailframe.llm import vectors

#: Vectors in one cover tree.
CHUNK = 1024
SCALE, SIZE, CENTROIDS, ROUNDS = 64, 64, 16, 3


@dataclass
class CoverTree:
    """Distinct points in the order of the leaves, so that a node's points are points[start:end]. Node 0 is the root. The point at `start`
    is the node's centre, and no point of the node is farther from it than `radius`. Children of node i are kids[first[i] : first[i + 1]].

    A node of level l has radius 2^l at most; its children's centres lie more than 2^(l - 1) apart, and each child holds points within
    2^(l - 1) of its centre. The node's own centre is the first child's (nesting). Levels that change nothing are skipped."""

    points: np.ndarray
    start: np.ndarray
    end: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    kids: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> tuple[CoverTree, np.ndarray]:
        """The tree of distinct rows x (one at least), and which row each of its points is."""
        exact = x.astype(np.float64)
        order: list[int] = []
        start, end, radius, children = [], [], [], []
        stack = [(np.arange(len(x)), np.sqrt(((exact - exact[0]) ** 2).sum(1)), -1)]
        while stack:  # a node is numbered when it leaves the stack: depth first, in the order of its leaves
            members, far, parent = stack.pop()
            node = len(start)
            if parent >= 0:
                children[parent].append(node)
            start.append(len(order))
            end.append(len(order) + len(members))
            radius.append(float(far.max()))
            children.append([])
            if len(members) == 1:
                order.append(int(members[0]))
                continue
            within = 2.0 ** (np.ceil(np.log2(radius[-1])) - 1)
            parts, rest, d = [], members, far
            while len(rest):
                near = d <= within
                near[0] = True  # the centre itself
                parts.append((rest[near], d[near], node))
                rest = rest[~near]
                if len(rest):
                    d = np.sqrt(((exact[rest] - exact[rest[0]]) ** 2).sum(1))
            stack += parts[::-1]
        first = np.cumsum([0, *map(len, children)])
        tree = cls(x[order], np.array(start), np.array(end), np.array(radius), first, np.array([k for c in children for k in c], np.int64))
        return tree, np.array(order)


def _spread(first: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For nodes with children: which of `nodes` each child belongs to, and where the child stands in `kids`."""
    n = first[nodes + 1] - first[nodes]
    of = np.repeat(np.arange(len(nodes)), n)
    return of, first[nodes][of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)


def nearest(tree: CoverTree, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """The nearest centroid of each of the tree's points, the smaller number on ties; and how many distances were computed."""
    distinct, number = np.unique(centroids, axis=0, return_index=True)  # of equal centroids the smallest number
    top, order = CoverTree.of(distinct)
    number = number[order]
    points, goals = tree.points.astype(np.float64), top.points.astype(np.float64)
    out = np.full(len(points), -1)
    computed = 0
    active = np.array([0])
    q, c = np.array([0]), np.array([0])  # pairs: place in `active`, node of the centroids
    while len(active):
        computed += len(q)
        rq, rc = tree.radius[active][q], top.radius[c]
        d = np.sqrt(((points[tree.start[active][q]] - goals[top.start[c]]) ** 2).sum(1))
        most = np.full(len(active), np.inf)
        np.minimum.at(most, q, d + rq)  # the centre of a node of centroids is a centroid
        keep = d - rq - rc <= most[q] * (1 + 1e-12) + 1e-9
        q, c = q[keep], c[keep]
        n = np.bincount(q, minlength=len(active))
        widest = np.zeros(len(active))
        np.maximum.at(widest, q, top.radius[c])
        leaf = tree.radius[active] == 0
        # one centroid left: all points of the node are its
        sole = (n == 1) & (widest == 0)
        for at, goal in zip(q[sole[q]], c[sole[q]], strict=True):
            out[tree.start[active[at]] : tree.end[active[at]]] = number[top.start[goal]]
        # a single point and several centroids: compared exactly
        last = leaf & (widest == 0) & ~sole
        if last.any():
            at, goal = q[last[q]], c[last[q]]
            exact = ((tree.points[tree.start[active[at]]] - top.points[top.start[goal]]) ** 2).sum(1)
            names = number[top.start[goal]]
            ranked = np.lexsort((names, exact, at))
            at, names = at[ranked], names[ranked]
            lead = np.r_[True, at[1:] != at[:-1]]
            out[tree.start[active[at[lead]]]] = names[lead]
            computed += len(exact)
        going = ~(sole | last)
        by_goal = going & (widest >= tree.radius[active]) & (widest > 0)
        by_point = going & ~by_goal
        # nodes of centroids give way to their children
        stays = by_goal[q] & (top.radius[c] == 0)
        opened = np.flatnonzero(by_goal[q] & (top.radius[c] > 0))
        of, kid = _spread(top.first, c[opened])
        place = np.cumsum(by_goal) - 1
        q1 = np.r_[place[q[stays]], place[q[opened][of]]]
        c1 = np.r_[c[stays], top.kids[kid]]
        # nodes of points give way to theirs, each with its parent's pairs
        parents = np.flatnonzero(by_point)
        of, kid = _spread(tree.first, active[parents])
        new = tree.kids[kid]
        mine = np.flatnonzero(by_point[q])
        mine = mine[np.argsort(q[mine], kind="stable")]
        n_pairs = n[parents]
        begins = np.r_[0, np.cumsum(n_pairs)[:-1]]
        repeat = n_pairs[of]
        child = np.repeat(np.arange(len(new)), repeat)
        q2 = by_goal.sum() + child
        c2 = c[mine[begins[of][child] + np.arange(len(child)) - np.repeat(np.cumsum(repeat) - repeat, repeat)]] if len(child) else np.empty(0, np.int64)
        active = np.r_[active[by_goal], new]
        q, c = np.r_[q1, q2].astype(np.int64), np.r_[c1, c2].astype(np.int64)
    return out, computed


_ARRAYS = ("points", "start", "end", "radius", "first", "kids")


def _stored(tree: CoverTree, place: np.ndarray, copies: np.ndarray) -> bytes:
    data = io.BytesIO()
    arrays = {a: getattr(tree, a) for a in _ARRAYS} | {"place": place, "copies": copies}
    np.savez(data, **{a: x.astype(np.int32) if x.dtype.kind == "i" else x for a, x in arrays.items()})
    return data.getvalue()


def _loaded(data: bytes) -> tuple[CoverTree, np.ndarray, np.ndarray]:
    x = np.load(io.BytesIO(data))
    return CoverTree(*[x[a].astype(np.int64) if x[a].dtype.kind == "i" else x[a] for a in _ARRAYS]), x["place"], x["copies"]


def forest(rows: DataFrame) -> DataFrame:
    """ids array<long>, tree binary: a cover tree for each chunk of CHUNK rows (vec_id, v of one length), with the place of each row among
    its points; equal vectors of a chunk are one point. Rows are not shuffled."""

    def run(batches):
        for ids, x in vectors.blocks(batches, CHUNK):
            distinct, place = np.unique(x, axis=0, return_inverse=True)
            tree, order = CoverTree.of(distinct)
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            place = rank[place.ravel()]
            data = _stored(tree, place, np.bincount(place, minlength=len(order)))
            yield pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([data], pa.binary())], ["ids", "tree"])

    return rows.mapInArrow(run, "ids array<long>, tree binary")


def _sums(trees: DataFrame, centroids: np.ndarray) -> list[tuple[int, int, list[int]]]:
    """cluster, number of vectors, componentwise sums: a row for each cluster reaches the driver."""
    k, width = centroids.shape

    def run(batches):
        n, s = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for batch in batches:
            for data in batch.column("tree"):
                tree, _, copies = _loaded(data.as_py())
                of, _ = nearest(tree, centroids)
                np.add.at(n, of, copies)
                np.add.at(s, of, tree.points * copies[:, None])
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used]), pa.array(list(s[used]), pa.list_(pa.int64()))], ["cluster", "n", "s"])

    found = trees.select("tree").mapInArrow(run, "cluster int, n long, s array<long>")
    found = found.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(width)]).alias("s"))
    return [(r["cluster"], r["n"], r["s"]) for r in found.collect()]


def start(rows: DataFrame, k: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of `1:<vec_id>`, in its order; null ids come last, equal ids by their vectors."""
    name = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    found = rows.orderBy(name.asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in found], np.int64)


def lloyd(rows: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """rows: vec_id long, v array<int> of one length. vec_id, cluster int, distance long (squared) of every row after `rounds` rounds, and
    the centroids. Every round is one pass over the trees, in place; what is shuffled is a sum for each cluster and task. Repeated rows and
    ids are rows like others, null ids too; ties go to the smaller number; no rows give no rows."""
    trees = C.checkpoint(forest(rows))
    centroids = start(rows, k)
    schema = "vec_id long, cluster int, distance long"
    if not len(centroids):
        return rows.sparkSession.createDataFrame([], schema), centroids
    for _ in range(rounds):
        for cluster, n, s in _sums(trees, centroids):
            centroids[cluster] = [x // n for x in s]

    def run(batches):
        for batch in batches:
            for ids, data in zip(batch.column("ids"), batch.column("tree"), strict=True):
                tree, place, _ = _loaded(data.as_py())
                of, _ = nearest(tree, centroids)
                distance = ((tree.points - centroids[of]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(of[place], pa.int32()), pa.array(distance[place])], ["vec_id", "cluster", "distance"])

    return C.checkpoint(trees.mapInArrow(run, schema)), centroids


def op11_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of all vectors of 64 finite components. Sums beyond a long are
    null."""
    rows = vectors.whole(C.read(spark, sf_dir, "embeddings"), SCALE, size=SIZE)
    found, centroids = lloyd(rows)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    totals = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fit = lambda x: F.lit(x if x < 1 << 63 else None).cast("long")
    of_cluster = F.array(*[fit(totals.get(i, 0)) for i in range(len(names))]) if names else F.array(fit(0))
    hashes = F.array(*[F.lit(n) for n in names or [""]])
    return found.select("vec_id", "cluster", "distance", F.get(of_cluster, F.col("cluster")).alias("cluster_inertia"), fit(sum(totals.values())).alias("inertia"), F.get(hashes, F.col("cluster")).alias("centroid_sha256"))
