"""Encounters of a stream: sessions by gap with a watermark. Rows without a time are dropped, as sessions of a stream have no end else."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_encounters(df: DataFrame, folder: str, ts: str, probability: str, label: str, gap: str, late: str) -> DataFrame:
    """folder, encounter_start, encounter_end, n, encounter, max_prob for each session; rows later than `late` are ignored."""
    best = F.max_by(label, F.struct(F.col(probability), -F.unix_micros(F.col(ts).cast("timestamp"))))
    sessions = df.withWatermark(ts, late).groupBy(folder, F.session_window(ts, gap).alias("w"))
    return sessions.agg(F.count("*").alias("n"), best.alias("encounter"), F.max(probability).alias("max_prob")).select(folder, F.col("w.start").alias("encounter_start"), F.col("w.end").alias("encounter_end"), "n", "encounter", "max_prob")
