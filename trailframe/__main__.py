"""Results of a folder: `python -m trailframe --dataPath FOLDER [--settingsPath FILE]`.

The folder holds the detector's document (`*.json`) and the classifier's scores (`scores.parquet`: File_Path, Targets, Date_Time, Crop,
probs). Written there: the full and the short table as CSV, and the detector's document with the results.
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from trailframe.operators import detections, results
from trailframe.sources import files


@dataclass
class Settings:
    CLASSES: list[str] = field(default_factory=list)
    ENCOUNTER_WINDOW: float = 30
    EMPTY_THRESHOLD: float = 0.5
    MD_EMPTY_THRESHOLD: float = 0.1
    PREDICTIONS: str = "predictions"


def infer(spark: SparkSession, folder: str, cfg: Settings) -> None:
    images = files.detector_json(spark, f"{folder}/*.json")
    boxes = detections.flatten(images).select(F.col("file").alias("File_Path"), "x_min", "y_min", F.col("width").alias("Width"), F.col("height").alias("Height"), F.col("confidence").alias("Confidence"))
    scored = spark.read.parquet(f"{folder}/scores.parquet")
    table = results.result_table(boxes, scored, cfg.CLASSES, window=cfg.ENCOUNTER_WINDOW, empty_threshold=cfg.EMPTY_THRESHOLD, md_empty_threshold=cfg.MD_EMPTY_THRESHOLD)
    files.write_results(table, f"{folder}/{cfg.PREDICTIONS}_full")
    files.write_results(table, f"{folder}/{cfg.PREDICTIONS}", narrow=results.SHORT)
    said = table.select(F.col("File_Path").alias("file"), F.col("Encounter").alias("encounter"), F.col("Max_Prob").alias("max_prob"))
    names = F.array(*[F.lit(c) for c in cfg.CLASSES])
    detections.write_document(detections.replaced(images, said, names), names, f"{folder}/{cfg.PREDICTIONS}_json")


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="trailframe", description=__doc__.split("\n")[0])
    parser.add_argument("--dataPath", required=True)
    parser.add_argument("--settingsPath")
    asked = parser.parse_args(arguments)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    cfg, unknown = files.read_settings(spark, asked.settingsPath, Settings()) if asked.settingsPath else (Settings(), [])
    if unknown:
        print("settings without a meaning here:", ", ".join(unknown))
    infer(spark, asked.dataPath.rstrip("/"), cfg)


if __name__ == "__main__":
    main()
