"""Expressions over arrays of probabilities; ties go to the lowest index."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def softmax(x: Column) -> Column:
    e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def ranked(probs: Column, digits: int | None = None) -> Column:
    """Structs (value, index) from the largest value down; with `digits`, values are rounded half to even first."""
    value = (lambda v: F.bround(v, digits)) if digits is not None else (lambda v: v)
    pairs = F.transform(probs, lambda v, i: F.struct(value(v).alias("value"), (-i).alias("minus")))
    return F.transform(F.reverse(F.array_sort(pairs)), lambda p: F.struct(p["value"].alias("value"), (-p["minus"]).alias("index")))


def argmax(probs: Column) -> Column:
    return -F.array_max(F.transform(probs, lambda v, i: F.struct(v.alias("v"), (-i).alias("i"))))["i"]


def flattened(lists: Column) -> Column:
    """The members of an array of arrays; null arrays inside are left out."""
    return F.flatten(F.filter(lists, lambda x: x.isNotNull()))


def one_hot(classes: list[str], value: Column) -> Column:
    return F.array(*[(F.coalesce(value == F.lit(c), F.lit(False))).cast("int") for c in classes])


def hot_index(hot: Column) -> Column:
    """Place (from 0) of the first 1; the first place where there is none, as for any array of equal numbers."""
    return argmax(hot)


def focal_loss(probs: Column, target: Column, gamma: float = 2.0, weights: list[float] | None = None) -> Column:
    """(1 - p) ^ gamma times cross-entropy (which gamma 0 leaves alone), times the target class's weight where `weights` are given."""
    p = F.get(probs, target)
    loss = F.pow(1 - p, F.lit(gamma)) * -F.ln(p)
    return loss if weights is None else loss * F.get(F.array(*[F.lit(float(w)) for w in weights]), target)
