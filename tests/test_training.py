"""Training of heads, and average precision of a class that holds nearly all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailframe.operators import inference, metrics, training


@pytest.mark.parametrize(("two_layers", "dropout"), [(False, 0.0), (True, 0.0), (True, 0.5)])
def test_gradient_against_finite_differences(two_layers, dropout):
    r = np.random.default_rng(1)
    head = training.Head.new(6, 3, two_layers, dropout, seed=2)
    x, w = r.normal(size=(9, 6)), r.uniform(0.5, 2, 9)
    y = r.dirichlet([1, 1, 1], 9)
    kept = r.random((9, 3)) >= 0.5 if dropout else None
    _, g = head.gradient(x, y, w, kept)
    values = head.flat()
    for i in range(len(values)):
        step = np.zeros(len(values))
        step[i] = 1e-5
        up, down = (head.with_flat(values + s).gradient(x, y, w, kept)[0] for s in (step, -step))
        assert g[i] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_adam_by_hand():
    adam = training.Adam(decay=0.1)
    one = adam.step(np.array([1.0]), np.array([0.4]), 0.01)
    assert one[0] == pytest.approx(1 - 0.01 * 0.5 / (0.5 + 1e-8))
    two = adam.step(one, np.array([-0.2]), 0.01)
    g = -0.2 + 0.1 * one[0]
    mean, square = 0.9 * 0.1 * 0.5 + 0.1 * g, 0.999 * 0.001 * 0.25 + 0.001 * g * g
    assert two[0] == pytest.approx(one[0] - 0.01 * mean / (1 - 0.81) / (np.sqrt(square / (1 - 0.999**2)) + 1e-8))


def points(spark, n=600):
    r = np.random.default_rng(5)
    means = r.normal(0, 1, (4, 8))
    rows = [(i, (means[i % 4] + r.normal(0, 0.4, 8)).tolist(), i % 4, "x") for i in range(n)]
    return spark.createDataFrame([*rows, (None, [0.0] * 8, 1, "x"), (n, None, 1, "x"), (n + 1, [0.0] * 8, None, "x"), (n + 2, [0.0] * 8, 7, "x")], "id long, f array<float>, label int, y string")


def plain(rows, head, rates):
    x, y = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows])
    adam = training.Adam()
    for rate in rates:
        _, g = head.gradient(x, y, np.ones(len(x)))
        head = head.with_flat(adam.step(head.flat(), g / len(x), rate))
    return head


def test_train(spark):
    df = points(spark)
    rows = training.examples(df, "id", "f", 4, label="label")
    assert rows.count() == 600
    rates = training.rates(spark, 40, rate=0.05, initial=0.01, least=0.001, warmup=3, cycle=40, decay=0.9)
    head = training.Head.new(8, 4, seed=3)
    found = training.train(rows, head, rates)
    assert np.abs(found.head.flat() - plain(rows.collect(), head, rates).flat()).max() < 1e-9
    assert found.losses[-1] < 0.3 * found.losses[0]
    again = training.train(rows, head, rates)
    assert (again.head.flat() == found.head.flat()).all() and again.losses == found.losses
    said = inference.classify(df.where("id < 600 and f is not null and label is not null"), ["f"], found.load("f"))
    hits = said.where(F.array_position("probs", F.array_max("probs")) - 1 == F.col("label")).count()
    assert hits > 0.95 * 600


def test_two_layers_with_dropout_whatever_the_partitions(spark):
    rows = training.examples(points(spark, 200), "id", "f", 4, label="label", weights=[1, 2, 1, 0.5])
    head = training.Head.new(8, 4, True, 0.5, seed=3)
    a = training.train(rows.repartition(2), head, [0.01] * 3, decay=1e-3, batches=2, seed=4)
    b = training.train(rows.repartition(40), head, [0.01] * 3, decay=1e-3, batches=2, seed=4)  # two levels of sums
    assert len(a.losses) == 6 and np.abs(a.head.flat() - b.head.flat()).max() < 1e-9
    c = training.train(rows.repartition(2), head, [0.01] * 3, decay=1e-3, batches=2, seed=5)
    assert np.abs(a.head.flat() - c.head.flat()).max() > 1e-6


def test_shares_as_targets_and_no_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], [0.25, 0.75]), (2, [1.0, 0.0], [1.0]), (3, [0.0, 1.0], [None, 1.0])], "id long, f array<double>, t array<double>")
    rows = training.examples(df, "id", "f", 2, targets="t")
    assert [(r["key"], r["y"]) for r in rows.collect()] == [(1, [0.25, 0.75])]
    head = training.Head.new(2, 2)
    empty = training.train(rows.where("key > 5"), head, [0.1])
    assert (empty.head.flat() == head.flat()).all() and empty.losses == []
    with pytest.raises(ValueError, match="components"):
        training.train(rows, training.Head.new(3, 2), [0.1])
    with pytest.raises(ValueError, match="either"):
        training.examples(df, "id", "f", 2)


def test_quantiles_against_sorted_values(spark):
    r = np.random.default_rng(2)
    groups = [None, 1, 2, 3]
    values = {1: r.integers(0, 5, 400).astype(float), 2: r.random(5000), 3: np.array([7.0]), None: np.array([1.0, 4.0])}
    rows = [(g, float(v)) for g in groups for v in values[g]] + [(g, None) for g in (1, 9)]
    df = spark.createDataFrame(rows, "g int, x double").repartition(4)
    shares = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.973, "e": 1.0}
    got = {q.g: q for q in metrics.quantiles(df, ["g"], "x", shares).collect()}
    assert set(got) == set(groups)
    for g in groups:
        assert [got[g][n] for n in shares] == pytest.approx(np.quantile(values[g], list(shares.values())))
    every = metrics.quantiles(df, [], "x", {"m": 0.5}).collect()
    assert [q.m for q in every] == pytest.approx([np.median(np.concatenate(list(values.values())))])
    told = {d.g: d for d in metrics.described(df, ["g"], "x").collect()}
    assert (told[9].n, told[9].middle, told[9].low) == (0, None, None) and told[2].q1 == pytest.approx(np.quantile(values[2], 0.25))
    assert metrics.quantiles(df.limit(0), ["g"], "x", shares).collect() == []


def test_average_precision_of_a_hot_class(spark):
    """95 % of the rows are of one class, half of them with scores near 0: ranges of a class are alike in size, and rows are the same."""
    r = np.random.default_rng(0)
    n = 20_000
    label = np.where(r.random(n) < 0.95, 0, r.integers(1, 4, n))
    score = np.where(r.random(n) < 0.5, r.random(n) * 1e-6, r.random(n)).round(9)
    score[r.random(n) < 0.1] = 0.5
    hit = (r.random(n) < score).astype(int)
    df = spark.createDataFrame([(int(a), float(b), int(c)) for a, b, c in zip(label, score, hit, strict=True)], "label int, score double, hit int").repartition(4)
    got = {x.label: (x.support, x.ap) for x in metrics.average_precision(df, "label", "score", "hit").collect()}
    for c in range(4):
        s, h = score[label == c], hit[label == c]
        ap, tp, seen = 0.0, 0, 0
        for v in np.unique(s)[::-1]:
            tp, seen = tp + h[s == v].sum(), seen + (s == v).sum()
            ap += h[s == v].sum() / h.sum() * tp / seen
        assert got[c] == (h.sum(), pytest.approx(ap))
    ranks = metrics.score_ranges(df.groupBy("label", "score").count(), "label", "score").where("label = 0").groupBy("__range").count().collect()
    sizes = [x["count"] for x in ranks]
    assert len(sizes) > 200 and max(sizes) < 2 * np.median(sizes)
    few = spark.createDataFrame([(1, None, 1), (1, 0.5, 0), (None, 0.2, 1), (2, 0.1, 0)], "label int, score double, hit int")
    assert {(x.label, x.support, round(x.ap, 6)) for x in metrics.average_precision(few, "label", "score", "hit").collect()} == {(1, 1, 0.5), (None, 1, 1.0)}
