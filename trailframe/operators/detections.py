"""Detections of images: flattening, the best of an image, joins with what is known, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DETECTION = "struct<category: string, conf: double, bbox: array<double>>"
DOCUMENT = f"images array<struct<file: string, detections: array<{DETECTION}>>>, detection_categories map<string, string>"
#: Fixed value: what stands for no detection.
NOTHING = {"category": "-1", "conf": -1.0, "bbox": [0.0, 0.0, 1.0, 1.0]}


def nothing() -> Column:
    return F.struct(F.lit(NOTHING["category"]).alias("category"), F.lit(NOTHING["conf"]).alias("conf"), F.array(*[F.lit(v) for v in NOTHING["bbox"]]).alias("bbox"))


def best(detections: Column) -> Column:
    """The detection of the largest confidence, the first of equal ones; the sentinel where there is none."""
    ranked = F.array_max(F.transform(detections, lambda d, i: F.struct(d["conf"].alias("c"), (-i).alias("i"), d.alias("d"))))
    return F.coalesce(ranked["d"], nothing())


def flatten(images: DataFrame, best_only: bool = True) -> DataFrame:
    """file, mega_class, confidence, x_min, y_min, width, height."""
    if best_only:
        rows = images.select("file", best(F.col("detections")).alias("d"))
    else:
        rows = images.select("file", F.explode(F.when(F.size("detections") > 0, F.col("detections")).otherwise(F.array(nothing()))).alias("d"))
    box = [F.get("d.bbox", F.lit(i)).alias(n) for i, n in enumerate(("x_min", "y_min", "width", "height"))]
    return rows.select("file", F.col("d.category").cast("int").alias("mega_class"), F.col("d.conf").alias("confidence"), *box)


def newest(df: DataFrame, key: str, order: str, *ties: str) -> DataFrame:
    """The last row of each key; of equally late ones that with the largest `ties`, then with the largest other values."""
    rest = [c for c, t in df.dtypes if c not in (key, order, *ties) and not t.startswith(("map", "variant"))]
    place = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in (order, *ties, *rest)])
    return df.withColumn("__n", F.row_number().over(place)).where("__n = 1").drop("__n")


def with_tags(df: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Rows beside their tags: only keys that both have, and a row for each of several tags of a key."""
    return df.join(cache, key)


def unseen(listed: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    return listed.join(known.select(*on), on, "left_anti")


def seen(listed: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    return listed.join(known.select(*on), on, "left_semi")


def class_ids(labels: Column) -> Column:
    """label -> 1-based place among the sorted distinct labels and `empty`."""
    names = F.array_sort(F.array_union(labels, F.array(F.lit("empty"))))
    return F.map_from_arrays(names, F.sequence(F.lit(1), F.size(names)))


def replaced(images: DataFrame, said: DataFrame, labels: Column, order: str | None = None) -> DataFrame:
    """file, category, conf, bbox of the images that `said` (file, encounter, max_prob) has: the encounter's id among `labels` (0 if it has
    none), its probability, and the box of the best detection. Of several rows of a file the last by `order` counts."""
    said = newest(said, "file", order or "max_prob").select("file", "encounter", "max_prob")
    category = F.coalesce(F.try_element_at(class_ids(labels), F.col("encounter")), F.lit(0))
    rows = images.select("file", "detections").join(said, "file")
    return rows.select("file", category.alias("category"), F.col("max_prob").alias("conf"), best(F.col("detections"))["bbox"].alias("bbox"))


def export_json(images: DataFrame) -> DataFrame:
    """file, json of {file, detections}."""
    return images.select("file", F.to_json(F.struct("file", "detections")).alias("json"))


def document_lines(rows: DataFrame, labels: Column) -> DataFrame:
    """The lines of one detector document with the rows of `replaced`: place, file, line. In order of (place, file) they are its text: the
    categories, an image a line, and the end. Nothing is gathered: a sorted text write leaves parts that follow each other."""
    spark = rows.sparkSession
    box = F.struct(F.col("category"), F.col("conf"), F.col("bbox"))
    images = rows.select(F.col("file").cast("string").alias("file"), F.to_json(F.struct("file", F.array(box).alias("detections"))).alias("json"))
    first = F.broadcast(images.agg(F.min("file").alias("__first")))  # one row
    comma = F.when(F.col("file") == F.col("__first"), "").otherwise(",")
    images = images.crossJoin(first).select(F.lit(1).alias("place"), "file", F.concat(comma, "json").alias("line"))
    names = F.map_from_entries(F.transform(F.map_entries(class_ids(labels)), lambda e: F.struct(e["value"].cast("string"), e["key"])))
    head = spark.range(1).select(F.lit(0).alias("place"), F.lit("").alias("file"), F.concat(F.lit('{"detection_categories":'), F.to_json(names), F.lit(',"images":[')).alias("line"))
    end = spark.range(1).select(F.lit(2).alias("place"), F.lit("").alias("file"), F.lit("]}").alias("line"))
    return head.unionByName(images).unionByName(end)


def write_document(rows: DataFrame, labels: Column, path: str) -> None:
    """The document as text, in parts that are it when read one after the other."""
    document_lines(rows, labels).orderBy("place", "file").select("line").write.mode("overwrite").text(path)
