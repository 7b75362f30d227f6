"""Choosing rows for training: filters, renames, caps for each group, splits, weights, samples. Every choice is an order of md5(key|seed)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailframe.operators import metrics


def order_of(seed: int, *key: str) -> Column:
    return F.md5(F.concat_ws("|", *key, F.lit(str(seed))))


def without(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose value isn't listed; nulls stay."""
    return df.where(F.coalesce(~F.col(column).isin(values), F.lit(True)))


def confident_or_rare(df: DataFrame, confidence: str, threshold: float, label: str, rare: list[str]) -> DataFrame:
    return df.where((F.col(confidence) >= threshold) | F.col(label).isin(rare))


def renamed(column: Column, names: dict[str, str]) -> Column:
    """All at once: a new name isn't renamed again."""
    out = F.when(column == next(iter(names)), names[next(iter(names))]) if names else column
    for old, new in list(names.items())[1:]:
        out = out.when(column == old, new)
    return out.otherwise(column) if names else column


def renamed_in_turn(column: Column, names: dict[str, str]) -> Column:
    """One after the other: a new name may be renamed by a later rule."""
    for old, new in names.items():
        column = F.when(column == old, new).otherwise(column)
    return column


def replaced_cells(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Every text column of the table, the rules one after the other."""
    return df.withColumns({c: renamed_in_turn(F.col(c), names) for c, t in df.dtypes if t == "string"})


def inverted(merges: dict[str, list[str]]) -> dict[str, str]:
    """{old: new} of settings {new: [old, ...]}; an old name in two lists goes to the later one."""
    return {old: new for new, olds in merges.items() for old in olds}


def valid(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that have all of the columns."""
    return df.dropna(subset=columns)


def cap_groups(df: DataFrame, groups: list[str], key: list[str], limit: int, seed: int = 0) -> DataFrame:
    """`limit` rows of each group at most. The literal limit lets each task keep `limit` rows of a group before the shuffle."""
    place = Window.partitionBy(*groups).orderBy(order_of(seed, *key), *key)
    return df.withColumn("__n", F.row_number().over(place)).where(F.col("__n") <= limit).drop("__n")


def adaptive_limit(n: Column, lower: int, upper: int) -> Column:
    return F.lit(lower) + F.least(F.greatest(F.floor((n - lower) / 2), F.lit(0)), F.lit(upper - lower))


def cap_groups_adaptive(df: DataFrame, groups: list[str], key: list[str], lower: int, upper: int, seed: int = 0) -> DataFrame:
    """As cap_groups, with a limit that follows the group's size. Each task keeps `upper` rows of a group before the shuffle; sizes come
    from an aggregation of their own, so no group is sorted whole. Rows with a null in `groups` form groups too."""
    sizes = df.groupBy(*groups).agg(F.count("*").alias("__all")).withColumnsRenamed({g: f"__g{i}" for i, g in enumerate(groups)})
    place = Window.partitionBy(*groups).orderBy(order_of(seed, *key), *key)
    first = df.withColumn("__n", F.row_number().over(place)).where(F.col("__n") <= upper)
    same = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(groups)]
    return first.join(sizes, same).where(F.col("__n") <= adaptive_limit(F.col("__all"), lower, upper)).select(*df.columns)


def without_rare(df: DataFrame, label: str, least: int) -> DataFrame:
    """Rows of labels that at least `least` rows have; rows without a label go."""
    common = df.groupBy(label).agg(F.count("*").alias("__n")).where(F.col("__n") >= least)
    return df.join(common.select(label), label, "left_semi")


def without_rare_columns(targets: DataFrame, predictions: DataFrame, classes: list[str], least: int) -> tuple[DataFrame, DataFrame]:
    """Both tables without the class columns whose 0/1 targets sum to less than `least`. One sum a class reaches the driver."""
    sums = targets.agg(*[F.coalesce(F.sum(F.col(f"`{c}`")), F.lit(0)).alias(f"s{i}") for i, c in enumerate(classes)]).first()
    rare = [c for i, c in enumerate(classes) if sums[i] < least]
    return targets.drop(*rare), predictions.drop(*rare)


def hash_bucket(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Adds __h, the hash that orders the rows, and __b, one of 4096 ranges of it."""
    return df.withColumn("__h", order_of(seed, key)).withColumn("__b", F.conv(F.substr("__h", F.lit(1), F.lit(3)), 16, 10).cast("int"))


def hash_ranked(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Adds __n, a row's place (from 1) by hashed order, and __all, the number of rows. Two scans and no global sort: rows are ranked in
    their bucket, after the sizes of those before it."""
    df = hash_bucket(df, key, seed)
    sizes = df.groupBy("__b").agg(F.count("*").alias("__c"))  # 4096 rows
    run = Window.orderBy("__b")
    sizes = sizes.select("__b", (F.sum("__c").over(run) - F.col("__c")).alias("__before"), F.sum("__c").over(Window.partitionBy()).alias("__all"))
    ranked = df.join(F.broadcast(sizes), "__b").withColumn("__n", F.col("__before") + F.row_number().over(Window.partitionBy("__b").orderBy("__h", key)))
    return ranked.drop("__h", "__b", "__before")


def split(df: DataFrame, key: str, test: float = 0.1, val: float = 0.1, seed: int = 0) -> DataFrame:
    """Adds `part`: exactly floor(test * n) rows test, floor(val * n) val, the rest train, by hashed order."""
    a = F.floor(F.lit(test) * F.col("__all"))
    b = a + F.floor(F.lit(val) * F.col("__all"))
    part = F.when(F.col("__n") <= a, "test").when(F.col("__n") <= b, "val").otherwise("train")
    return hash_ranked(df, key, seed).withColumn("part", part).drop("__all", "__n")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """label, n, weight = mean n / n, root_weight = mean of the roots of n / root of n, sampling_weight = 1 / root of n. A row for each
    class."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    every = Window.partitionBy()  # a row for each class
    weight, root = F.avg("n").over(every) / F.col("n"), F.avg(F.sqrt("n")).over(every) / F.sqrt("n")
    return counts.select(label, "n", weight.alias("weight"), root.alias("root_weight"), (1 / F.sqrt("n")).alias("sampling_weight"))


def uniform(seed: int, *key: str) -> Column:
    """In (0, 1), from the first 13 digits of the hash."""
    return (F.conv(F.substr(order_of(seed, *key), F.lit(1), F.lit(12)), 16, 10).cast("double") + 0.5) / float(16**12)


def smallest(df: DataFrame, value: str, key: str, n: int) -> DataFrame:
    """The n rows of the smallest values, ties by key; nulls come last. For any n no task sorts more than one of some 256 ranges of the
    values: ranges before the one where n is reached stay whole, and only that one is ranked."""
    rows = metrics.score_ranges(df.withColumns({"__one": F.lit(0), "__low": -F.col(value)}), "__one", "__low")
    sizes = rows.groupBy("__range").agg(F.count("*").alias("__c"))  # a row for each range
    sizes = sizes.select(F.col("__range").alias("__r"), (F.sum("__c").over(Window.orderBy("__range")) - F.col("__c")).alias("__before"), "__c")
    rows = rows.join(F.broadcast(sizes), F.col("__range") == F.col("__r")).where(F.col("__before") < n)
    split = F.col("__before") + F.col("__c") > n
    place = F.row_number().over(Window.partitionBy("__range").orderBy(F.col(value).asc_nulls_last(), key))
    cut = rows.where(split).withColumn("__n", place).where(F.col("__before") + F.col("__n") <= n)
    return rows.where(~split).select(*df.columns).unionByName(cut.select(*df.columns))


def weighted_sample(df: DataFrame, key: str, weight: Column, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, with chances by weight: the smallest exponential keys. Rows whose weight is null or not above 0 come
    last, by key."""
    keyed = df.withColumn("__e", F.when(weight > 0, -F.ln(uniform(seed, key)) / weight))
    return smallest(keyed, "__e", key, n).drop("__e")


def min_max_scaled(df: DataFrame, groups: list[str], column: str, name: str) -> DataFrame:
    """Adds `name`: the column's place between the least and the largest value of its group, from 0 to 1; 0 where all are equal, null stays
    null. The ends come from an aggregation, so no group is brought together."""
    ends = df.groupBy(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)]).agg(F.min(column).alias("__least"), F.max(column).alias("__most"))
    same = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(groups)] or [F.lit(True)]
    span = F.col("__most") - F.col("__least")
    value = F.when(F.col(column).isNotNull(), F.when(span > 0, (F.col(column) - F.col("__least")) / span).otherwise(0.0))
    return df.join(ends, same, "left").withColumn(name, value).select(*df.columns, name)


def group_sizes(df: DataFrame, groups: list[str], **conditions: Column) -> DataFrame:
    """n of each group, and how many of its rows meet each condition."""
    return df.groupBy(*groups).agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in conditions.items()])


def known_classes(df: DataFrame, label: str, unknown: str) -> DataFrame:
    """One row: n_known distinct labels without `unknown`, n_unknown rows that have it, and all names in order."""
    known = F.when(F.col(label) != unknown, F.col(label))
    return df.agg(F.countDistinct(known).alias("n_known"), F.count_if(F.col(label) == unknown).alias("n_unknown"), F.array_sort(F.collect_set(label)).alias("names"))
