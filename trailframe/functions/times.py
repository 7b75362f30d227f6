"""Times from and to text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed formats: results' times, cameras' times.
RESULT, CAMERA = "dd/MM/yyyy HH:mm:ss", "yyyy:MM:dd HH:mm:ss"
FORMATS = [CAMERA, "yy:MM:dd HH:mm:ss", RESULT]


#: What each letter of a format matches: years are of fixed width, other numbers may lack their leading zero, white space is any.
WIDTHS = {"yyyy": r"\d{4}", "yy": r"\d{2}", "MM": r"\d{1,2}", "dd": r"\d{1,2}", "HH": r"\d{1,2}", "mm": r"\d{1,2}", "ss": r"\d{1,2}", " ": r"\s+"}


def parsed(text: Column, form: str) -> Column:
    """The time, or null. Numbers of one digit count, years of two digits lie in 1969 to 2068."""
    parts = re.findall("|".join(WIDTHS) + "|.", form)
    fits = text.rlike("^" + "".join(WIDTHS.get(p) or re.escape(p) for p in parts) + r"\z")
    loose = "".join(p if p.startswith("y") or p not in WIDTHS else p[0] for p in parts)
    ts = F.when(fits, F.try_to_timestamp(F.regexp_replace(text, r"\s+", " "), F.lit(loose)))
    if "yyyy" in form or "yy" not in form:
        return ts
    return F.when(F.year(ts) > 2068, F.add_months(ts, -1200).cast("timestamp") + (ts - F.date_trunc("day", ts))).otherwise(ts)


def first_format(text: Column, formats: list[str] = FORMATS) -> Column:
    return F.coalesce(*[parsed(text, f) for f in formats])


def result_text(text: Column, formats: list[str] = FORMATS) -> Column:
    """The time as results carry it; null for text in none of the formats."""
    return F.date_format(first_format(text, formats), RESULT)


def run_id(now: Column) -> Column:
    return F.date_format(now, "yy_MM_dd_HH")


def impute_mean(df: DataFrame, column: str) -> DataFrame:
    """Nulls become the mean of the column, cut to microseconds."""
    mean = df.agg(F.timestamp_micros(F.avg(F.unix_micros(F.col(column).cast("timestamp"))).cast("long")).alias("__mean"))
    return df.crossJoin(F.broadcast(mean)).withColumn(column, F.coalesce(column, "__mean")).drop("__mean")


def seconds_since(ts: Column, start: str = "2023-01-01 00:00:00") -> Column:
    return F.unix_timestamp(ts) - F.unix_timestamp(F.lit(start).cast("timestamp"))


def time_of_day(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")


def add_milliseconds(ts: Column, ms: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts.cast("timestamp")) + F.floor(ms * 1000))
