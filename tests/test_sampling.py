"""Samples of an exact size, draws, and diverse rows against plain versions; tags of photos; tables of results."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from trailframe.functions import exif
from trailframe.operators import curation, detections, metrics, sampling, scores


def test_exact_sizes(spark):
    df = spark.range(1001)
    assert sampling.sample_exact(df, "id", 0.25).count() == 250
    assert sampling.stride(df, "id", 20).count() == 51
    assert sampling.sample_exact(df.limit(0), "id", 0.5).count() == 0


def test_draws_follow_the_weights_and_skip_rows_without_one(spark):
    df = spark.createDataFrame([(1, 100_000), (2, 50_000), (3, 0), (4, None), (5, 1), (6, -3)], "id long, w long")
    got = sampling.weighted_draws(df, "id", F.col("w"), 6000, bins=64)
    counts = {r.id: r.n for r in got.groupBy("id").agg(F.count("*").alias("n")).collect()}
    assert sum(counts.values()) == 6000 and not {3, 4, 6} & set(counts) and None not in counts
    assert abs(counts[1] - 4000) < 200 and got.select("draw").distinct().count() == 6000
    assert sampling.weighted_draws(df.where("id = 3"), "id", F.col("w"), 10).count() == 0


def plain_diverse(rows, lower, upper, rounds):
    """rows: (group, key, values). The keys kept."""
    kept = []
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g]
        n = len(own)
        if n < lower:
            kept += [r[1] for r in own]
            continue
        x = np.array([r[2] for r in own], float)
        lo, hi = x.min(0), x.max(0)
        x = np.where(hi > lo, (x - lo) / np.where(hi > lo, hi - lo, 1), 0.0)
        order = sorted(range(n), key=lambda i: (hashlib.md5(f"{own[i][1]}|0".encode()).hexdigest(), own[i][1]))
        centres = x[order[: lower + min(max((n - lower) // 2, 0), upper - lower)]]
        for _ in range(rounds):
            near = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
            centres = np.array([x[near == i].mean(0) for i in range(len(centres)) if (near == i).any()])
        d = ((x[:, None] - centres[None]) ** 2).sum(2)
        near = d.argmin(1)
        for i in set(near.tolist()):
            kept.append(min((d[j, i], own[j][1]) for j in range(n) if near[j] == i)[1])
    return sorted(kept)


def test_diverse_rows(spark):
    r = np.random.default_rng(1)
    rows = [("a" if i < 60 else None if i < 65 else "b", i, [float(v) for v in r.random(2)]) for i in range(100)]
    df = spark.createDataFrame([(g, k, *v) for g, k, v in rows], "g string, k long, x double, y double").withColumn("same", F.lit(1.0))
    got = sampling.diverse_rows(df, ["g"], "k", ["x", "y", "same"], 8, 20, rounds=3)
    assert sorted(x.k for x in got.collect()) == plain_diverse([(str(g), k, [*v, 1.0]) for g, k, v in rows], 8, 20, 3)
    assert got.columns == df.columns and got.where("g is null").count() == 5
    assert sampling.diverse_rows(df.limit(0), ["g"], "k", ["x"], 8, 20, rounds=1).count() == 0


def test_tags(spark):
    rows = [("c", "o", "d", True, True), ("c", "  ", None, True, True), (None, None, "", True, True), ("c", "o", "d", False, True), ("c", "o", "d", True, False)]
    df = spark.createDataFrame(rows, "c string, o string, d string, h boolean, r boolean")
    tags = exif.date_and_description(*[F.col(x) for x in "codhr"])
    got = [tuple(r) for r in df.select(*tags.values()).collect()]
    assert got == [("o", "d"), ("c", "description_not_found"), ("dt_not_found", ""), ("exif_not_found",) * 2, ("file_not_valid",) * 2]


def test_replaced_detections(spark):
    images = spark.createDataFrame([("a", [("1", 0.2, [0.5, 0.0, 1.0, 1.0])]), ("b", []), ("c", None), ("d", [])], f"file string, detections array<{detections.DETECTION}>")
    said = spark.createDataFrame([("a", "cat", 0.9), ("b", "empty", 0.8), ("c", "owl", 0.7)], "file string, encounter string, max_prob double")
    got = {r.file: (r.category, r.conf, r.bbox[0]) for r in detections.replaced(images, said, F.array(F.lit("dog"), F.lit("cat"))).collect()}
    assert got == {"a": (1, 0.9, 0.5), "b": (3, 0.8, 0.0), "c": (0, 0.7, 0.0)}


def test_tables_of_results(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 3)], "t int, p int")
    r = metrics.macro(df, "t", "p").first()
    assert (r.balanced_accuracy, r.n_classes) == (0.5, 2) and abs(r.macro_f1 - (2 / 3 + 0.5) / 2) < 1e-9
    frames = spark.createDataFrame([(1, 2, "y", 0.1), (1, 1, None, 0.4), (1, 3, "z", None)], "v int, f int, x string, c double")
    assert [tuple(x) for x in scores.video_metadata(frames, "v", "f", ["x"], "c").collect()] == [(1, "y", 0.4)]
    assert [x.k for x in curation.without_rare(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "k int, c string"), "c", 2).orderBy("k").collect()] == [1, 2]
    a = spark.createDataFrame([(1, 5), (2, 6)], "k int, x int")
    assert [tuple(x) for x in scores.assembled([a, a.select("k", (F.col("x") + 1).alias("y")).where("k = 1")], "k").collect()] == [(1, 5, 6)]
