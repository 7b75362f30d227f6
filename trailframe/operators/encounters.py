"""Encounters: runs of a folder's rows with no gap above a limit, and the best row of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def encounters(df: DataFrame, folder: str, ts: str, probability: str, label: str, key: str, gap_seconds: float, undated_join: bool = True,
               text: str | None = None) -> DataFrame:
    """Adds encounter_start, encounter (the label of the row with the largest probability, first by time and key) and max_prob.

    A gap of exactly `gap_seconds` doesn't open an encounter. Rows without a time come last: with undated_join they belong to the last
    encounter of their folder and may win it, but their own encounter is their own label; else they stand alone. `text` names the column
    that the time was read from: then only rows without that text keep their own label, and rows whose text is no time share the
    label of the folder's last encounter. One shuffle, by folder.
    """
    order = Window.partitionBy(folder).orderBy(F.col(ts).asc_nulls_last(), F.col(key))
    before = F.lag(ts).over(order)
    opens = before.isNull() | (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(before.cast("timestamp")) > int(gap_seconds * 1_000_000))
    df = df.withColumn("__open", F.when(F.col(ts).isNotNull() & opens, F.col(ts)))
    df = df.withColumn("encounter_start", F.last("__open", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__open")
    if not undated_join:
        df = df.withColumn("encounter_start", F.when(F.col(ts).isNotNull(), F.col("encounter_start")))
    group = Window.partitionBy(folder, "encounter_start")
    ranked = group.orderBy(F.col(probability).desc_nulls_last(), F.col(ts).asc_nulls_last(), F.col(key))
    first = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = F.col(text if text and undated_join else ts).isNull() | F.col("encounter_start").isNull()
    df = df.withColumn("__best", F.first(label).over(first)).withColumn("__most", F.max(probability).over(group))
    said = {"encounter": F.when(own, F.col(label)).otherwise(F.col("__best")), "max_prob": F.when(own, F.col(probability)).otherwise(F.col("__most"))}
    return df.withColumns(said).drop("__best", "__most")


def encounters_by_span(df: DataFrame, folder: str, ts: str, probability: str, label: str, key: str, gap_seconds: float, span_seconds: int = 86400,
                       text: str | None = None) -> DataFrame:
    """The same rows and columns as `encounters`, with undated_join, for folders that are too long to be sorted in one task, or encounters that are.

    Rows are sorted in spans of time. A row for each span, with its first and last time and the start of its last run, tells where a run
    goes on from one span to the next; these rows alone are sorted by folder. The best row of an encounter comes from an aggregation.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = int(gap_seconds * 1_000_000)
    df = df.withColumn("__at", micros).withColumn("__span", F.floor(F.col("__at") / (span_seconds * 1_000_000)))
    order = Window.partitionBy(folder, "__span").orderBy("__at", key)
    before = F.lag("__at").over(order)
    dated = df.where("__at is not null").withColumn("__open", F.when(before.isNull() | (F.col("__at") - before > gap), F.col("__at")))
    dated = dated.withColumn("__start", F.last("__open", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__open")

    spans = dated.groupBy(F.col(folder).alias("__f"), F.col("__span").alias("__s"))
    spans = spans.agg(F.min("__at").alias("__first"), F.max("__at").alias("__last"), F.max("__start").alias("__run"))
    along = Window.partitionBy("__f").orderBy("__s")
    goes_on = F.coalesce(F.col("__first") - F.lag("__last").over(along) <= gap, F.lit(False))
    spans = spans.withColumn("__goes_on", goes_on)
    own = F.when(~F.col("__goes_on") | (F.col("__run") > F.col("__first")), F.col("__run"))  # else the last run began in an earlier span
    spans = spans.withColumn("__own", own)
    carried = F.last("__own", ignorenulls=True)
    spans = spans.withColumn("__carried", carried.over(along.rowsBetween(Window.unboundedPreceding, -1))).withColumn("__end", carried.over(along.rowsBetween(Window.unboundedPreceding, 0)))

    same = F.col(folder).eqNullSafe(F.col("__f"))
    first_run = F.col("__goes_on") & (F.col("__start") == F.col("__first"))
    dated = dated.join(spans, same & (F.col("__span") == F.col("__s"))).withColumn("__start", F.when(first_run, F.col("__carried")).otherwise(F.col("__start")))
    last = spans.groupBy("__f").agg(F.max("__end").alias("__start"))
    rows = dated.select(*df.columns, "__start").unionByName(df.where("__at is null").join(last, same, "left").select(*df.columns, "__start"))

    p = F.col(probability)
    rank = F.struct(p.isNull(), -p, F.col("__at").isNull(), F.col("__at"), F.col(key))
    best = rows.where("__start is not null").groupBy(F.col(folder).alias("__f"), F.col("__start").alias("__b"))
    best = best.agg(F.min_by(label, rank).alias("__best"), F.max(probability).alias("__most"))
    rows = rows.join(best, same & (F.col("__start") == F.col("__b")), "left")
    alone = F.col(text or "__at").isNull() | F.col("__start").isNull()
    said = {"encounter": F.when(alone, F.col(label)).otherwise(F.col("__best")), "max_prob": F.when(alone, p).otherwise(F.col("__most"))}
    start = F.timestamp_micros("__start").cast(dict(df.dtypes)[ts])
    return rows.withColumns({"encounter_start": start, **said}).drop("__at", "__span", "__start", "__f", "__b", "__best", "__most")
