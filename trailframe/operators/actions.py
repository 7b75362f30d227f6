"""Copies and deletions of files as a table: nothing here touches a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailframe.functions import paths


def copies(files: DataFrame, path: str, target: str) -> DataFrame:
    """action, source, target: each file to the folder `target`, under its own name."""
    to = F.concat(F.lit(target.rstrip("/") + "/"), paths.base_name(F.col(path)))
    return files.select(F.lit("copy").alias("action"), F.col(path).alias("source"), to.alias("target"))


def replaced_folder(files: DataFrame, path: str, target: str, folder: Column) -> DataFrame:
    """action, source, target, step: first `target` goes, then files whose `folder` (its name) isn't null come to target/folder, with the
    rest of their path below it."""
    rows = files.withColumn("__folder", folder).where("__folder is not null")
    mark = F.concat(F.lit("/"), F.col("__folder"), F.lit("/"))
    rest = F.substr(F.col(path), F.position(mark, F.col(path)) + F.length(mark))
    to = F.concat(F.lit(target.rstrip("/") + "/"), F.col("__folder"), F.lit("/"), rest)
    moved = rows.select(F.lit("copy").alias("action"), F.col(path).alias("source"), to.alias("target"), F.lit(1).alias("step"))
    gone = files.sparkSession.range(1).select(F.lit("delete").alias("action"), F.lit(None).cast("string").alias("source"), F.lit(target).alias("target"), F.lit(0).alias("step"))
    return gone.unionByName(moved)
