"""Pairs of examples mixed for training, without a join of the table to itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailframe.operators.curation import order_of

#: Pairs of numbers that a draw may take: each is accepted with a chance of a half at least.
TRIES = 64


def _number(text: Column) -> Column:
    """In (0, 1), from the first 12 digits of the hash."""
    return (F.conv(F.substr(F.md5(text), F.lit(1), F.lit(12)), 16, 10).cast("double") + 0.5) / float(16**12)


def beta(alpha: float, *name: Column) -> Column:
    """A number from the beta distribution with both parameters alpha, in (0, 1], by the hash of `name`: the first pair of numbers to the
    power 1 / alpha whose sum is 1 at most gives the first's share."""
    if not 0 < alpha <= 1:
        raise ValueError("alpha must lie above 0, and not above 1")
    named = F.concat_ws(":", *[n.cast("string") for n in name])

    def pair(i: Column) -> Column:
        x, y = (F.pow(_number(F.concat(named, F.lit(c), i.cast("string"))), F.lit(1 / alpha)) for c in "xy")
        return F.struct(x.alias("x"), (x + y).alias("sum"))

    first = F.get(F.filter(F.transform(F.sequence(F.lit(1), F.lit(TRIES)), pair), lambda p: (p["sum"] <= 1) & (p["sum"] > 0)), F.lit(0))
    return first["x"] / first["sum"]


def mixed(df: DataFrame, key: str, features: str, target: str, batch: int = 32, alpha: float = 0.5, seed: int = 0) -> DataFrame:
    """The table with `lam`, `partner` (a row's key), `other_target`, and its features as lam times its own and 1 - lam times the
    partner's. Rows are dealt to batches of about `batch` by the hash of their keys; those of a batch have one lam from the beta
    distribution, and each is partner of one other: of the one before it in hashed order, the first of the last. A batch of one row is
    mixed with itself. With alpha 0 nothing is mixed. The same whatever the partitions; keys must be unique, null features stay null, and
    what one of a pair has more of is null. Two scans: one counts the rows."""
    if not alpha:
        return df.select("*", F.lit(1.0).alias("lam"), F.col(key).alias("partner"), F.col(target).alias("other_target"))
    batches = max(1, round(df.count() / batch))
    named = order_of(seed, key)
    rows = df.withColumn("__h", named).withColumn("__b", F.pmod(F.conv(F.substr("__h", F.lit(1), F.lit(12)), 16, 10).cast("long"), F.lit(batches)))
    draws = df.sparkSession.range(batches).select(F.col("id").alias("__b"), beta(alpha, F.lit(seed), F.col("id")).alias("lam"))
    rows = rows.join(draws, "__b")
    order = Window.partitionBy("__b").orderBy("__h", key)
    partner = F.struct(F.col(key).alias("partner"), F.col(target).alias("other_target"), F.col(features).alias("__f"))
    first = F.first(partner).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("__p", F.coalesce(F.lead(partner).over(order), first))
    rows = rows.withColumn(features, F.zip_with(F.col(features), F.col("__p.__f"), lambda a, b: F.col("lam") * a + (1 - F.col("lam")) * b))
    return rows.select(*df.columns, "lam", "__p.partner", "__p.other_target")


def mixed_loss(loss: Column, other: Column, lam: Column) -> Column:
    """Of the losses against the two targets."""
    return lam * loss + (1 - lam) * other
