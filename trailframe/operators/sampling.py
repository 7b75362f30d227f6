"""Samples of an exact size, draws with replacement, and diverse rows of each group, none by a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailframe.operators.curation import adaptive_limit, hash_bucket, hash_ranked, order_of, uniform
from trailframe.sources.shared import settled


def sample_exact(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """round(share * n) rows, halves to even, without replacement: the first by hashed order."""
    return hash_ranked(df, key, seed).where(F.col("__n") <= F.bround(F.lit(share) * F.col("__all"), 0)).drop("__n", "__all")


def sample_rows(df: DataFrame, key: str, n: int = 500, seed: int = 0) -> DataFrame:
    """Exactly n rows, the first by hashed order; a ValueError if there are fewer."""
    rows = df.count()
    if rows < n:
        raise ValueError(f"a sample of {n} rows needs as many, there are {rows}")
    return hash_ranked(df, key, seed).where(F.col("__n") <= n).drop("__n", "__all")


def stride(df: DataFrame, key: str, step: int, seed: int = 0) -> DataFrame:
    """The first row and every `step`th after it, by hashed order."""
    return hash_ranked(df, key, seed).where((F.col("__n") - 1) % step == 0).drop("__n", "__all")


def weighted_draws(df: DataFrame, key: str, weight: Column, n: int, seed: int = 0, bins: int = 4096) -> DataFrame:
    """draw, key: n draws with replacement, with chances by `weight`, cut to whole numbers; rows of less than 1 are never drawn, and
    without any other there are no draws. The rows lie end to end on a line, in hashed order; a draw is a point of it. Bins of one length
    hold points alike, whatever the weights: a row that spans several is in each of them."""
    rows = hash_bucket(df.select(key, weight.cast("long").alias("__w")).where("__w >= 1"), key, seed)
    sizes = rows.groupBy("__b").agg(F.sum("__w").alias("__c"))  # 4096 rows
    sizes = sizes.select("__b", (F.sum("__c").over(Window.orderBy("__b")) - F.col("__c")).alias("__before"), F.sum("__c").over(Window.partitionBy()).alias("__all"))
    upto = F.col("__before") + F.sum("__w").over(Window.partitionBy("__b").orderBy("__h", key).rowsBetween(Window.unboundedPreceding, 0))
    width = F.ceil(F.col("__all") / bins)
    line = rows.join(F.broadcast(sizes), "__b").select(key, (upto - F.col("__w")).alias("__s"), (upto - 1).alias("__e"), width.alias("__width"))
    line = line.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("__s") / F.col("__width")), F.floor(F.col("__e") / F.col("__width")))))
    line = line.select("__bin", F.greatest("__s", F.col("__bin") * F.col("__width")).alias("__at"), F.lit(None).cast("long").alias("draw"), key)
    whole = sizes.select("__all").distinct()  # one row, or none
    points = df.sparkSession.range(n).crossJoin(F.broadcast(whole)).withColumn("__at", F.floor(uniform(seed + 1, "id") * F.col("__all")))
    points = points.select(F.floor(F.col("__at") / width).alias("__bin"), "__at", F.col("id").alias("draw"), F.lit(None).cast(df.schema[key].dataType).alias(key))
    before = Window.partitionBy("__bin").orderBy("__at", F.col("draw").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return line.unionByName(points).withColumn(key, F.last(key, ignorenulls=True).over(before)).where("draw is not null").select("draw", key)


def diverse_rows(df: DataFrame, groups: list[str], key: str, features: list[str], lower: int, upper: int, rounds: int = 5, seed: int = 0) -> DataFrame:
    """Groups of fewer than `lower` rows whole; of others the row nearest to each of lower + (n - lower) / 2 centres, `upper` at most.
    `key` is unique. Features are scaled to 0..1 in their group (0 if all are alike; null counts as 0). The centres start at the first
    rows by hashed order and move to the mean of their rows `rounds` times; one that loses its rows goes, so a group may give fewer rows.
    A group's rows never meet in one task: only its centres do, `upper` at most. Rows with a null in `groups` form groups too."""
    x = [F.col(c).cast("double") for c in features]
    ranges = df.groupBy(*groups).agg(F.count("*").alias("__all"), *[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(f"__r{i}") for i, c in enumerate(x)])

    def beside(rows: DataFrame, other: DataFrame) -> DataFrame:
        named = other.withColumnsRenamed({g: f"__g{i}" for i, g in enumerate(groups)})
        same = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(groups)]
        return rows.join(named, same).drop(*[f"__g{i}" for i in range(len(groups))])

    def scaled(i: int) -> Column:
        lo, hi = F.col(f"__r{i}.lo"), F.col(f"__r{i}.hi")
        return F.coalesce(F.when(hi > lo, (x[i] - lo) / (hi - lo)), F.lit(0.0))

    points = beside(df, ranges).select(*groups, key, "__all", F.array(*[scaled(i) for i in range(len(x))]).alias("__x"))
    small = points.where(F.col("__all") < lower).select(key)
    large = settled(points.where(F.col("__all") >= lower))
    first = large.withColumn("__n", F.row_number().over(Window.partitionBy(*groups).orderBy(order_of(seed, key), key))).where(F.col("__n") <= upper)
    first = first.where(F.col("__n") <= adaptive_limit(F.col("__all"), lower, upper))
    centres = settled(first.groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct(F.col("__n").alias("n"), F.col("__x").alias("x")))).alias("__cs")))

    def assigned() -> DataFrame:
        def apart(c: Column) -> Column:
            return F.aggregate(F.zip_with(c["x"], F.col("__x"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)

        near = F.array_min(F.transform("__cs", lambda c: F.struct(apart(c).alias("d"), c["n"].alias("n"))))
        return beside(large, centres).select(*groups, key, "__x", near["n"].alias("__n"), near["d"].alias("__d"))

    for _ in range(rounds):
        moved = assigned().groupBy(*groups, "__n").agg(*[F.avg(F.get("__x", F.lit(i))).alias(f"__m{i}") for i in range(len(x))])
        centre = F.struct(F.col("__n").alias("n"), F.array(*[f"__m{i}" for i in range(len(x))]).alias("x"))
        centres = settled(moved.groupBy(*groups).agg(F.array_sort(F.collect_list(centre)).alias("__cs")))
    chosen = assigned().groupBy(*groups, "__n").agg(F.min_by(key, F.struct("__d", key)).alias(key)).select(key)
    return df.join(small.unionByName(chosen), key, "left_semi").select(*df.columns)
