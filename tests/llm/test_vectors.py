"""Dual-tree Lloyd and sorted lists against brute force."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trailframe.llm import dual_tree, sorted_lists, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, v string, cluster long, score double, ids int"


def table(spark, rows):
    return spark.createDataFrame([(i, e, 1, "x", 2, 0.5, 3) for i, e in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, other lengths, numbers that aren't finite, copies, repeated ids, ties, and a vector that a third of the rows hold."""
    r = np.random.default_rng(3)
    means = r.normal(0, 1, (5, 64))
    near = [(i, (means[i % 5] + r.normal(0, 0.02, 64)).astype(np.float32).tolist()) for i in range(150)]
    hot = near[7][1]
    rows = near + [(1000 + i, hot) for i in range(90)] + [(50, near[3][1]), (50, near[50][1]), (None, near[4][1]), (50, near[50][1])]
    bad = [(2001, None), (2002, []), (2003, hot[:10]), (2004, [*hot[:63], None]), (2005, [*hot[:63], float("nan")]), (2006, [*hot[:63], float("inf")]), (2000, [*hot, 1.0]), (2050, [0.0] * 64), (2051, [*hot[:63], 3e38])]
    return rows + bad


def scaled(rows, scale, size=None):
    out = []
    for i, e in rows:
        if e is None or any(x is None or not np.isfinite(x) or abs(x) * scale >= vectors.LARGEST - 1 for x in e) or size not in (None, len(e)):
            continue
        out.append((i, [int(np.floor(float(np.float32(x)) * scale)) for x in e]))
    return out


def lloyd(rows, k=16, rounds=3):
    ordered = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    c = [list(v) for _, v in ordered[:k]]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c)) for _, v in rows]

    for _ in range(rounds):
        of = assigned()
        for j in range(len(c)):
            mine = [v for (_, v), (_, n) in zip(rows, of, strict=True) if n == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return assigned(), c


def test_lloyd_by_brute_force(spark, odd, tmp_path):
    table(spark, odd).write.parquet(str(tmp_path / "embeddings.parquet"))
    found = dual_tree.op11_dual_tree(spark, str(tmp_path)).collect()
    rows = scaled(odd, 64, 64)
    of, c = lloyd(rows)
    names = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    sums = [sum(d for d, j in of if j == n) for n in range(16)]
    key = lambda x: tuple((v is None, v) for v in x)
    want = sorted([(i, j, d, sums[j], sum(sums), names[j]) for (i, _), (d, j) in zip(rows, of, strict=True)], key=key)
    assert sorted(map(tuple, found), key=key) == want


def test_lloyd_with_few_rows(spark, tmp_path):
    for name, rows in (("none", []), ("bad", [(1, None)]), ("one", [(1, [0.5] * 64)]), ("same", [(i, [0.25] * 64) for i in range(40)])):
        table(spark, rows).write.parquet(str(tmp_path / name / "embeddings.parquet"))
        found = dual_tree.op11_dual_tree(spark, str(tmp_path / name)).collect()
        assert len(found) == sum(e is not None for _, e in rows)
        assert all(r["cluster"] == 0 and r["inertia"] == 0 for r in found)


def test_cover_tree_invariants():
    r = np.random.default_rng(0)
    x = np.unique(r.integers(-60, 60, (300, 3)), axis=0)
    tree, order = dual_tree.CoverTree.of(x)
    assert (tree.points == x[order]).all() and sorted(order) == list(range(len(x)))
    d = lambda a, b: np.sqrt(((tree.points[a] - tree.points[b]) ** 2).sum(-1))
    for i in range(len(tree.start)):
        s, e, kids = tree.start[i], tree.end[i], tree.kids[tree.first[i] : tree.first[i + 1]]
        assert np.isclose(d(slice(s, e), s).max(), tree.radius[i])
        if not len(kids):
            assert e - s == 1
            continue
        level = np.ceil(np.log2(tree.radius[i]))
        assert tree.start[kids[0]] == s and [*tree.start[kids], e] == [s, *tree.end[kids]]
        assert all(tree.radius[k] <= 2 ** (level - 1) for k in kids)
        assert all(d(tree.start[a], tree.start[b]) > 2 ** (level - 1) for a in kids for b in kids if a != b)


def test_pairs_are_pruned_where_vectors_cluster():
    r = np.random.default_rng(1)
    means = r.integers(-2000, 2000, (16, 8))
    x = np.unique(means[r.integers(0, 16, 4000)] + r.integers(-20, 20, (4000, 8)), axis=0)
    tree, _ = dual_tree.CoverTree.of(x)
    of, computed = dual_tree.nearest(tree, means)
    exact = ((tree.points[:, None] - means[None]) ** 2).sum(-1)
    assert (of == exact.argmin(1)).all() and computed < exact.size / 20


def test_nearest_with_ties_and_equal_centroids():
    r = np.random.default_rng(2)
    for dim, span in ((1, 6), (2, 4), (3, 50)):
        x = np.unique(r.integers(-span, span, (200, dim)), axis=0)
        c = r.integers(-span, span, (12, dim))
        c[5] = c[2]
        tree, _ = dual_tree.CoverTree.of(x)
        of, _ = dual_tree.nearest(tree, c)
        assert (of == ((tree.points[:, None] - c[None]) ** 2).sum(-1).argmin(1)).all()


def best(rows, k=5):
    out = []
    for a, (q, v) in enumerate(rows):
        if q is None or q % 50:
            continue
        scores = [(-sum(x * y for x, y in zip(v, w, strict=False)), i is None, i) for b, (i, w) in enumerate(rows) if b != a]
        out += [(q, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def test_top_k_by_brute_force(spark, odd, tmp_path):
    table(spark, odd).write.parquet(str(tmp_path / "embeddings.parquet"))
    found = sorted_lists.op12_sorted_lists(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found), key=str) == best(scaled(odd, 256))


def test_top_k_in_several_passes_and_small_blocks(spark, odd, monkeypatch):
    rows = scaled(odd, 256)
    df = spark.createDataFrame(rows, "vec_id long, v array<int>").repartition(2)
    found = sorted_lists.top_k(df, df.where(F.col("vec_id") % 50 == 0), 5, most=2).collect()
    assert sorted(map(tuple, found), key=str) == best(rows)


def test_blocks_of_long_vectors_are_small():
    r = np.random.default_rng(0)
    rows = [(i, r.integers(-9, 9, r.choice([0, 1, 7, 300])).tolist()) for i in range(400)]
    batches = [pa.RecordBatch.from_pydict({"vec_id": [i for i, _ in rows[a : a + 90]], "v": pa.array([v for _, v in rows[a : a + 90]], pa.list_(pa.int32()))}) for a in range(0, 400, 90)]
    seen = []
    for ids, x in vectors.blocks(batches, 50, 2000):
        assert len(x) <= 50 and x.size <= 2000 and len(ids) == len(x)
        seen += [(i, row[: len(dict(rows)[i])].tolist(), row[len(dict(rows)[i]) :].any()) for i, row in zip(ids.to_pylist(), x, strict=True)]
    assert seen == [(i, v, False) for i, v in rows]
    assert [x.shape for _, x in vectors.blocks(batches[:1], 50, 10)][0][0] >= 1


def test_top_k_with_few_rows(spark):
    empty = spark.createDataFrame([], "vec_id long, v array<int>")
    assert sorted_lists.top_k(empty, empty).collect() == []
    two = spark.createDataFrame([(0, [1, 2]), (7, [3])], "vec_id long, v array<int>")
    assert [tuple(r) for r in sorted_lists.top_k(two, two.where("vec_id = 0")).collect()] == [(0, 1, 7, 3)]
    none = spark.createDataFrame([(0, []), (7, []), (3, [])], "vec_id long, v array<int>")
    assert sorted(tuple(r) for r in sorted_lists.top_k(none, none.where("vec_id = 0")).collect()) == [(0, 1, 3, 0), (0, 2, 7, 0)]


def test_lists_lose_no_candidate_and_stop_early():
    r = np.random.default_rng(5)
    x = r.integers(-50, 50, (3000, 6)) * np.array([20, 9, 4, 2, 1, 1])
    lists = sorted_lists.Lists(x)
    for _ in range(20):
        q = r.integers(-5, 6, 6)
        scores = x @ q
        sixth = np.sort(scores)[-6]
        at, entries = lists.candidates(q, 6, -np.inf)
        assert set(np.flatnonzero(scores >= sixth)) <= set(at)
        at, entries = lists.candidates(q, 6, float(sixth))
        assert set(np.flatnonzero(scores >= sixth)) <= set(at)
        assert entries < x.size or not q.all()
