"""Early stopping, kept checkpoints and mixed examples against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from trailframe.operators import mixup, stopping


def replayed(history, patience, kept):
    run, rows = stopping.Run(), []
    for at, loss in history:
        if run.stopped:
            break
        rows.append([at, run.check(at, loss, patience, kept), run.wait, run.stopped])
    ats = {a for _, a in run.saved}
    return [(a, i, w, s, a in ats) for a, i, w, s in rows]


def test_a_history_by_hand():
    """Patience 2, three kept: 5, 3, 3 (no gain), 2, 4, 2 ends it. Saved: 5 3 3, then 2 for 5, not 4, and 2 for the older 3."""
    rows = replayed([(1, 5.0), (2, 3.0), (3, 3.0), (4, 2.0), (5, 4.0), (6, 2.0), (7, 0.0)], 2, 3)
    assert rows == [(1, True, 0, False, False), (2, True, 0, False, False), (3, False, 1, False, True), (4, True, 0, False, True), (5, False, 1, False, False), (6, False, 2, True, True)]
    assert replayed([(1, float("nan"))], 2, 3) == [(1, False, 1, True, True)]


def histories(n):
    r = random.Random(7)
    out = {}
    for run in range(n):
        losses = [r.choice([None, float("nan"), float("inf")]) if r.random() < 0.02 else float(r.randint(0, 6) + max(0, 12 - i)) for i in range(r.randint(1, 40))]
        out[run] = list(enumerate(losses))
    out[None] = [(0, 1.0), (1, 0.5)]
    return out


@pytest.mark.parametrize(("patience", "kept"), [(2, 8), (6, 3), (40, 1), (40, 8)])
def test_windows_against_the_state(spark, patience, kept):
    runs = histories(60)
    df = spark.createDataFrame([(run, at, loss, "x") for run, h in runs.items() for at, loss in h], "run int, at long, loss double, n string").drop("n").repartition(5)
    rows = stopping.checks(df, "run", "at", "loss", patience, kept).collect()
    for run, history in runs.items():
        mine = sorted((r.at, r.improved, r.wait, r.stops, r.kept) for r in rows if r.run == run)
        assert mine == replayed(history, patience, kept), (run, history)
    best = {r.run: r for r in stopping.best_checks(df, "run", "at", "loss", patience, kept).collect()}
    for run, history in runs.items():
        plain = replayed(history, patience, kept)
        assert (best[run].checks, best[run].stopped, best[run].kept_at) == (len(plain), plain[-1][3], [a for a, *_, k in plain if k])
        assert best[run].best_at == max((a for a, i, *_ in plain if i), default=None)


def test_stream(spark, tmp_path):
    runs = {r: h for r, h in histories(12).items() if r is not None}
    schema = "run int, at long, loss double"
    source = tmp_path / "in"
    for part in range(3):  # each run's checks come in three batches
        rows = [(run, at, loss) for run, h in runs.items() for at, loss in h if at * 3 // len(h) == part]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = stopping.stream_checks(spark.readStream.schema(schema).parquet(str(source)), "run", "at", "loss", 5, 4)
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    for run, history in runs.items():
        mine = sorted((r.at, r.improved, r.stopped, r.kept_at) for r in got if r.run == run)
        plain = replayed(history, 5, 4)
        assert [m[:3] for m in mine] == [(a, i, s) for a, i, _, s, _ in plain]
        assert mine[-1][3] == [a for a, *_, k in plain if k]


def test_mixed(spark):
    rows = [(i, [float(i), 1.0], i % 3, 0.5) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, f array<double>, t int, lam2 double")
    got = mixup.mixed(df.repartition(3), "id", "f", "t", 16, 0.5, 4).collect()
    assert sorted(r.id for r in got) == sorted(r.partner for r in got) == list(range(1000))
    assert all(r.f == pytest.approx([r.lam * r.id + (1 - r.lam) * r.partner, 1.0]) and r.other_target == r.partner % 3 for r in got)
    lams = {r.lam for r in got}
    assert 40 < len(lams) <= 63
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixup.mixed(df.repartition(7), "id", "f", "t", 16, 0.5, 4).collect()), key=str)
    one = mixup.mixed(df.where("id = 5"), "id", "f", "t").first()
    assert (one.partner, one.f) == (5, [5.0, 1.0])
    assert mixup.mixed(df, "id", "f", "t", alpha=0).where("lam <> 1 or partner <> id").count() == 0
    assert mixup.mixed(df.limit(0), "id", "f", "t").collect() == []
    with pytest.raises(ValueError, match="alpha"):
        mixup.mixed(df, "id", "f", "t", alpha=1.5)


@pytest.mark.parametrize("alpha", [0.2, 0.5, 1.0])
def test_beta(spark, alpha):
    """Mean 1/2 and variance 1 / (4 (2 alpha + 1)), within four standard errors of 20,000 draws."""
    draws = spark.range(20_000).select(mixup.beta(alpha, F.lit("s"), F.col("id")).alias("b"))
    mean, variance, low, high = draws.agg(F.avg("b"), F.var_samp("b"), F.min("b"), F.max("b")).first()
    assert abs(mean - 0.5) < 4 * (variance / 20_000) ** 0.5 and variance == pytest.approx(1 / (4 * (2 * alpha + 1)), rel=0.03)
    assert 0 <= low and high <= 1
