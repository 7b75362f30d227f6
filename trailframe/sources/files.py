"""Readers, writers and listings of files."""

from __future__ import annotations

import ast
import json
from dataclasses import fields, is_dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trailframe.functions import paths
from trailframe.operators import curation
from trailframe.operators.detections import DETECTION, DOCUMENT
from trailframe.sources import media

IMAGES, VIDEOS = (".jpg", ".jpeg"), (".avi", ".mp4", ".mkv", ".mov")
#: Fixed value: the time of a video that has none.
NO_TIME = "1977-10-22 00:00:00"


def detector_json(spark: SparkSession, path: str) -> DataFrame:
    """file, detections of a detector's document."""
    return spark.read.schema(DOCUMENT).option("multiLine", True).json(path).select(F.explode("images").alias("i")).select("i.*")


def detector_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """file, detections; and id, name of the categories, of a document as `detections.write_document` writes it: an image a line, in any number
    of parts. Lines are read by many tasks, where `detector_json` reads a document of any layout, and so each file, in one."""
    lines = spark.read.text(path)
    image = F.from_json(F.regexp_replace("value", "^,", ""), f"file string, detections array<{DETECTION}>")
    images = lines.where(F.col("value").rlike(r'^,?\{"(file|detections)":')).select(image.alias("i")).select("i.*")
    head = F.from_json(F.concat("value", F.lit("]}")), DOCUMENT)
    names = lines.where(F.col("value").startswith('{"detection_categories":')).select(F.explode(head["detection_categories"]).alias("id", "name"))
    return images, names


def parquet_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table, or no rows where there is no such path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def listing(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = IMAGES + VIDEOS) -> DataFrame:
    """path, modificationTime, length of files with these suffixes, in any case; contents are not read. Tasks list the folders; in stores
    that only Spark opens its own listing serves, which the driver holds whole."""
    try:
        return media.listed(spark, folder, suffixes)
    except pa.ArrowInvalid:
        pass
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "modificationTime", "length")
    return files.where(paths.suffix(F.col("path")).isin(*suffixes))


def contents(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = IMAGES, beside: DataFrame | None = None) -> DataFrame:
    """path, modificationTime, length, content of files with these suffixes, in any case. With `beside` (name, and other columns) only those
    of these names (the last part of the path), and its columns: the listing is joined, before contents are read, so they are not shuffled."""

    def named(found: DataFrame) -> DataFrame:
        return found if beside is None else found.withColumn("name", F.regexp_extract("path", "([^/]*)$", 1)).join(beside, "name")

    try:
        return media.with_contents(named(media.listed(spark, folder, suffixes)))
    except pa.ArrowInvalid:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
        return named(files.where(paths.suffix(F.col("path")).isin(*suffixes)))


def videos(files: DataFrame, path: str = "path") -> DataFrame:
    """The videos of a listing with `video_id`, dense from 0: by extension in the order of VIDEOS, then by a hash of the path. Ranks come from
    the sizes of 4 x 4096 ranges of the hash, so no task sorts all of them."""
    kind = F.array_position(F.array(*[F.lit(v) for v in VIDEOS]), paths.suffix(F.col(path)))
    rows = curation.hash_bucket(files.withColumn("__kind", kind).where("__kind > 0"), path).withColumn("__b", (F.col("__kind") - 1) * 4096 + F.col("__b"))
    sizes = rows.groupBy("__b").agg(F.count("*").alias("__c"))
    sizes = sizes.select("__b", (F.sum("__c").over(Window.orderBy("__b")) - F.col("__c")).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__b").orderBy("__h", path))
    return rows.join(F.broadcast(sizes), "__b").withColumn("video_id", F.col("__before") + place - 1).drop("__b", "__h", "__kind", "__before")


def class_folders(files: DataFrame, root: str, path: str = "path") -> DataFrame:
    """name: the distinct names of folders two levels below `root` that hold a file, sorted."""
    below = paths.parts(F.regexp_replace(F.col(path), "^(file:)?/+", "/"))
    depth = len([x for x in root.split("/") if x]) + 1
    name = F.when(F.size(below) > depth + 2, F.get(below, F.lit(depth + 1)))
    return files.select(name.alias("name")).where("name is not null").distinct().orderBy("name")


def newest_file(files: DataFrame) -> DataFrame:
    return files.orderBy(F.col("modificationTime").desc(), "path").limit(1)


def labelled_images(files: DataFrame, classes: list[str]) -> DataFrame:
    """A full-frame box of confidence 1 for each file, with the parent folder as its class if it is one."""
    label = F.lower(paths.parent_name(F.col("path")))
    box = {"confidence": 1.0, "x_min": 0.0, "y_min": 0.0, "width": 1.0, "height": 1.0}
    return files.select(F.col("path").alias("file_path"), F.when(label.isin(*classes), label).otherwise(paths.UNKNOWN).alias("target"), *[F.lit(v).alias(k) for k, v in box.items()])


def capture_time(modified, created=None):
    return F.coalesce(modified, *([created] if created is not None else []), F.lit(NO_TIME).cast("timestamp"))


def csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=True)


def write_results(df: DataFrame, path: str, narrow: list[str] | None = None, format: str = "csv") -> None:
    """CSV (with header), JSON or Parquet; `narrow` keeps those columns."""
    out = df.select(*narrow) if narrow else df
    writer = out.write.mode("overwrite")
    writer.csv(path, header=True) if format == "csv" else writer.format(format).save(path)


def read_classes(spark: SparkSession, path: str) -> list[str]:
    """The names of a JSON list of classes."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<string>").alias("names")).where("names is not null")
    return [name for r in rows.collect() for name in r["names"]]


def write_classes(spark: SparkSession, names: list[str], path: str) -> None:
    spark.createDataFrame([(json.dumps(names),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_settings(spark: SparkSession, path: str, defaults):
    """`settings` of a YAML file."""
    import yaml

    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    return settings(defaults, yaml.safe_load(text) or {})


def settings(defaults, values: dict):
    """The dataclass with the values whose names it has; text that looks like a Python literal is read as one. Returns it and the names
    that it doesn't have."""
    if not is_dataclass(defaults):
        raise TypeError("defaults must be a dataclass")
    names = {f.name for f in fields(defaults)}
    known = {}
    for k, v in values.items():
        if k in names:
            try:
                known[k] = ast.literal_eval(v) if isinstance(v, str) else v
            except (ValueError, SyntaxError):
                known[k] = v
    return replace(defaults, **known), sorted(set(values) - names)
