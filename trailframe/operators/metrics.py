"""Measures of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailframe.sources.shared import settled


#: Ranges of score that a class's rows are ranked in: a power of two. Ends of ranges that are sent to all tasks at most (8 MB).
RANGES, SENT = 256, 1 << 20


def score_ranges(scores: DataFrame, label: str, score: str, ranges: int = RANGES) -> DataFrame:
    """Adds __range: 0 for the highest scores of the row's label, up to ranges - 1 for the lowest, of about as many rows each. Equal scores
    share one. The ends of ranges come from a sketch of bounded size for each label; null scores count as the lowest."""
    shares = F.array(*[F.lit(1 - i / ranges) for i in range(1, ranges)])
    cuts = settled(scores.groupBy(F.col(label).alias("__label")).agg(F.percentile_approx(score, shares, 8 * ranges).alias("__cuts")))
    if cuts.count() * ranges <= SENT:  # else a label's rows meet those ends in a join that splits hot labels
        cuts = F.broadcast(cuts)
    value = F.col(score)
    # the first cut that the score reaches, by halves
    steps = F.array(*[F.lit(ranges >> i) for i in range(1, ranges.bit_length())])
    place = F.aggregate(steps, F.lit(0), lambda low, step: F.when(value < F.get("__cuts", low + step - 1), low + step).otherwise(low))
    found = scores.join(cuts, F.col(label).eqNullSafe(F.col("__label")))
    return found.withColumn("__range", F.when(value.isNull() | F.col("__cuts").isNull(), ranges - 1).otherwise(place)).drop("__label", "__cuts")


def average_precision(scores: DataFrame, label: str, score: str, hit: str, ranges: int = RANGES) -> DataFrame:
    """label, support, ap for rows (label, score, hit 0/1): the sum of precision times the rise of recall over distinct scores, for
    classes with a hit. Rows with one score are summed before they are ranked; a class is ranked in ranges of score, after the sums of the
    ranges above, so no task sorts a class, however large."""
    ties = settled(scores.groupBy(label, score).agg(F.sum(hit).alias("tp"), F.count("*").alias("n")))  # read three times
    ties = score_ranges(ties, label, score, ranges)
    sums = ties.groupBy(F.col(label).alias("__label"), F.col("__range").alias("__r")).agg(F.sum("tp").alias("__tp"), F.sum("n").alias("__n"))
    above, whole = Window.partitionBy("__label").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("__label")
    before = [F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_before") for c in ("__tp", "__n")]
    sums = sums.select("__label", "__r", *before, F.sum("__tp").over(whole).alias("support")).where("support > 0")
    rows = ties.join(sums, F.col(label).eqNullSafe(F.col("__label")) & (F.col("__range") == F.col("__r")))
    down = Window.partitionBy(label, "__range").orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, 0)
    tps, ns = F.col("__tp_before") + F.sum("tp").over(down), F.col("__n_before") + F.sum("n").over(down)
    runs = rows.select(label, "support", (F.col("tp") / F.col("support") * tps / ns).alias("part"))
    return runs.groupBy(label).agg(F.max("support").alias("support"), F.sum("part").alias("ap"))


def accuracy(df: DataFrame, target: str, prediction: str) -> DataFrame:
    """One row: the share of rows whose prediction is the target, of those that have both; null without any."""
    return df.agg(F.avg((F.col(target) == F.col(prediction)).cast("double")).alias("accuracy"))


def mean_loss(df: DataFrame, losses: dict[str, Column]) -> DataFrame:
    """One row: the mean of each loss, nulls aside."""
    return df.agg(*[F.avg(v).alias(k) for k, v in losses.items()])


def confusion(df: DataFrame, target: str, prediction: str) -> DataFrame:
    return df.groupBy(target, prediction).agg(F.count("*").alias("n"))


def class_scores(df: DataFrame, target: str, prediction: str) -> DataFrame:
    """label, tp, fp, fn, precision, recall, f1 of every label that is a target or a prediction."""
    pairs = confusion(df, target, prediction)
    rows = pairs.select(F.explode(F.array(F.struct(F.col(target).alias("label"), F.lit("t").alias("as")), F.struct(F.col(prediction).alias("label"), F.lit("p").alias("as")))).alias("x"), target, prediction, "n")
    same = F.col(target) == F.col(prediction)
    rows = rows.groupBy(F.col("x.label").alias("label")).agg(F.sum(F.when(same & (F.col("x.as") == "t"), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(~same & (F.col("x.as") == "p"), F.col("n")).otherwise(0)).alias("fp"), F.sum(F.when(~same & (F.col("x.as") == "t"), F.col("n")).otherwise(0)).alias("fn"))

    def share(a, b):
        return F.when(b > 0, a / b).otherwise(0.0)

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return rows.withColumns({"precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn)})


def macro(df: DataFrame, target: str, prediction: str) -> DataFrame:
    """One row: balanced_accuracy (mean recall), macro_f1, n_classes, over labels that are a target."""
    rows = class_scores(df, target, prediction).where("tp + fn > 0")
    return rows.agg(F.avg("recall").alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"), F.count("*").alias("n_classes"))


def quantiles(df: DataFrame, groups: list[str], column: str, shares: dict[str, float]) -> DataFrame:
    """The groups and a column for each share: the exact quantile of the values that aren't null, between two values in proportion. Values
    are counted, and their places found in ranges of a group after the counts of the ranges below, so no task holds a group's values.
    Groups without a value have no row."""
    counts = settled(df.where(F.col(column).isNotNull()).groupBy(*groups, column).agg(F.count("*").alias("__n")))
    ranged = score_ranges(counts.withColumn("__key", F.struct(*groups, F.lit(0).alias("__one"))), "__key", column)
    sums = ranged.groupBy(F.col("__key").alias("__k"), F.col("__range").alias("__r")).agg(F.sum("__n").alias("__c"))
    below = Window.partitionBy("__k").orderBy(F.col("__r").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__k", "__r", F.coalesce(F.sum("__c").over(below), F.lit(0)).alias("__below"), F.sum("__c").over(Window.partitionBy("__k")).alias("__all"))
    rows = ranged.join(sums, F.col("__key").eqNullSafe(F.col("__k")) & (F.col("__range") == F.col("__r")))
    end = F.col("__below") + F.sum("__n").over(Window.partitionBy("__key", "__range").orderBy(column).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.select(*groups, "__key", column, "__all", end.alias("__end"), (end - F.col("__n")).alias("__start"))
    ends = []
    for name, share in shares.items():
        at = F.lit(float(share)) * (F.col("__all") - 1)
        for part, place in (("low", F.floor(at)), ("high", F.ceil(at))):
            ends.append(F.max(F.when((F.col("__start") <= place) & (place < F.col("__end")), F.col(column).cast("double"))).alias(f"__{name}_{part}"))
    found = rows.groupBy(*groups, "__key").agg(F.max("__all").alias("__all"), *ends)
    part = lambda share: F.lit(float(share)) * (F.col("__all") - 1) - F.floor(F.lit(float(share)) * (F.col("__all") - 1))
    values = [((1 - part(s)) * F.col(f"__{n}_low") + part(s) * F.col(f"__{n}_high")).alias(n) for n, s in shares.items()]
    return found.select(*groups, *values)


#: Fixed shares.
QUARTILES = {"q1": 0.25, "middle": 0.5, "q3": 0.75}


def described(df: DataFrame, groups: list[str], column: str, exact: bool = True) -> DataFrame:
    """n, mean, std, low, q1, middle, q3, high of the values that aren't null. Quartiles are exact, or of a sketch of bounded size, which takes
    one pass."""
    c = F.col(column)
    sketched = [] if exact else [F.percentile_approx(c, share, 10000).cast("double").alias(name) for name, share in QUARTILES.items()]
    out = df.groupBy(*groups).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("low"), *sketched, F.max(c).alias("high"))
    if exact:
        named = {g: f"__g{i}" for i, g in enumerate(groups)}
        exact_ones = quantiles(df, groups, column, QUARTILES).withColumnsRenamed(named)
        out = out.join(exact_ones, [F.col(g).eqNullSafe(F.col(n)) for g, n in named.items()] or F.lit(True), "left")
    return out.select(*groups, "n", "mean", "std", "low", *QUARTILES, "high")


def described_columns(df: DataFrame, columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    """As `described`, a row for each of the columns (all numeric ones if none are named), named in `column`."""
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    columns = columns or [c for c, t in df.dtypes if t.startswith(kinds)]
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])).alias("cell")
    return described(df.select(cells).select("cell.column", "cell.value"), ["column"], "value", exact)


def threshold_sweep(df: DataFrame, confidence: str, probability: str, is_empty: str, thresholds: list[float]) -> DataFrame:
    """threshold, tp, fp, tn, fn, precision, recall of the rule `both below the threshold means empty`; the rows are read once. A share of
    nothing is 0."""
    cuts = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    said = (F.col(confidence) < F.col("threshold")) & (F.col(probability) < F.col("threshold"))
    true = F.col(is_empty)
    counts = {"tp": said & true, "fp": said & ~true, "tn": ~said & ~true, "fn": ~said & true}
    rows = df.select(confidence, probability, is_empty, cuts).groupBy("threshold").agg(*[F.count_if(c).alias(n) for n, c in counts.items()])

    def share(of: str) -> Column:
        whole = F.col("tp") + F.col(of)
        return F.when(whole > 0, F.col("tp") / whole).otherwise(0.0)

    return rows.withColumns({"precision": share("fp"), "recall": share("fn")})


def throughput(rows: int, seconds: float) -> float:
    """Rows a second; 0 for no time."""
    return rows / seconds if seconds > 0 else 0.0
