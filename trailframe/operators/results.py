"""The table of results of a folder: detections and scores become encounters, videos and empty images.

The order of the steps matters: images below the detector's threshold are relabelled before encounters are formed, images are declared
empty after, and files without a score are added last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailframe.functions import arrays, paths, times
from trailframe.operators import scores
from trailframe.operators.encounters import encounters, encounters_by_span

BOX = ["x_min", "y_min", "Width", "Height", "Confidence"]
#: Columns of the full table, before one for each class; and of the short one.
FULL = ["File_Path", "Date_Time", "Encounter_Start", "Encounter", "Max_Prob", "Targets", "Prediction", "Probability", "Second_Pred", "Second_Prob", "Third_Pred", "Third_Prob", "Crop", *BOX]
SHORT = ["File_Path", "Date_Time", "Encounter", "Max_Prob"]
_RANKED = {"prediction": "Prediction", "probability": "Probability", "second_pred": "Second_Pred", "second_prob": "Second_Prob", "third_pred": "Third_Pred", "third_prob": "Third_Prob"}


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, r"[\\/][^\\/]*$", "")


def _unscored(empties: DataFrame, n: int) -> DataFrame:
    """Rows of images that no classifier saw: zeros for all that it would say, and the whole image as crop."""
    zero, none = F.lit(0.0), F.lit("0")
    rows = scores.marked_empties(empties, "Confidence", "prediction")
    rows = rows.withColumns({"probability": zero, "second_pred": none, "second_prob": zero, "third_pred": none, "third_prob": zero})
    return rows.withColumns({"Crop": F.lit("[0, 0, 1, 1]"), "probs": F.array_repeat(zero, n)})


def result_table(labels: DataFrame, scored: DataFrame, classes: list[str], empties: DataFrame | None = None, window: float = 30, empty_threshold: float = 0.0, md_empty_threshold: float = 0.5, video_threshold: float = 0.7, span_seconds: int | None = None) -> DataFrame:
    """FULL and a column for each class, to three digits.

    labels: File_Path and BOX, a row for each image. scored: File_Path, Targets, Date_Time (as text), Crop and probs, an array in the order
    of `classes`. Images of `labels` that `scored` lacks are `unprocessed`. `empties` (File_Path, Targets, Date_Time and BOX) are images
    that were kept from the classifier; without it, all images below the threshold are relabelled `empty`. With `span_seconds`
    a folder's images are sorted in spans of so many seconds, else each folder in one task; the rows are the same.
    """
    names = F.array(*[F.lit(c) for c in classes])
    scored = scored.withColumn("probs", F.transform("probs", lambda v: F.bround(v, 4)))
    rows = labels.select("File_Path", *BOX).join(scored.select("File_Path", "Targets", "Date_Time", "Crop", "probs"), "File_Path")
    rows = scores.top_three(rows, "probs", names, 4)
    if empties is None:
        rows = scores.relabel_empties(rows, "Confidence", md_empty_threshold)
    else:
        rows = rows.unionByName(_unscored(empties.select("File_Path", "Targets", "Date_Time", *BOX), len(classes)))
    rows = rows.withColumn("__folder", _folder(F.col("File_Path")))
    videos, images = scores.split_videos(rows, "File_Path")
    images = images.withColumn("__ts", F.try_to_timestamp("Date_Time", F.lit(times.RESULT)))
    if span_seconds is None:
        images = encounters(images, "__folder", "__ts", "probability", "prediction", "File_Path", window, text="Date_Time")
    else:
        images = encounters_by_span(images, "__folder", "__ts", "probability", "prediction", "File_Path", window, span_seconds, "Date_Time")
    images = images.withColumn("Encounter_Start", times.time_of_day(F.col("encounter_start")))
    out = images.drop("__ts", "__folder").unionByName(_videos(videos, names, video_threshold))
    out = scores.empty_encounters(out, "Confidence", md_empty_threshold, "max_prob", empty_threshold)
    missing = labels.select("File_Path").join(scored.select("File_Path"), "File_Path", "left_anti")
    out = out.unionByName(missing.withColumns({c: F.lit(scores.UNPROCESSED) for c in ("encounter", "Targets", "prediction")}), allowMissingColumns=True)
    out = out.withColumnsRenamed(_RANKED | {"encounter": "Encounter", "max_prob": "Max_Prob"})
    numbers = {"Max_Prob", "Probability", "Second_Prob", "Third_Prob", *BOX}
    fixed = [F.bround(F.col(c).cast("double"), 3).alias(c) if c in numbers else F.col(c) for c in FULL]
    return out.select(*fixed, *[F.bround(F.get("probs", F.lit(i)), 3).alias(c) for i, c in enumerate(classes)])


def _videos(frames: DataFrame, names: Column, threshold: float) -> DataFrame:
    """A row for each video, under the path of the video that the frames were taken from."""
    frames = frames.withColumn("__video", paths.decode_frame(F.col("File_Path")))
    kept = ["__video", "Date_Time", "Targets", "Crop", "x_min", "y_min", "Width", "Height"]
    rows = scores.collapse_videos(frames, "__folder", "File_Path", "Confidence", "probs", threshold, kept)
    # means to nine digits: the same whatever the order that frames were added in
    rows = rows.withColumn("probs", F.transform("probs", lambda v: F.bround(v, 9))).withColumn("__r", arrays.ranked(F.col("probs")))
    for i, (label, value) in enumerate((("prediction", "probability"), ("second_pred", "second_prob"), ("third_pred", "third_prob"))):
        rows = rows.withColumns({label: F.get(names, F.get("__r", F.lit(i))["index"]), value: F.get("__r", F.lit(i))["value"]})
    start = times.time_of_day(F.try_to_timestamp("Date_Time", F.lit(times.RESULT)))
    rows = rows.withColumns({"Encounter_Start": start, "encounter": F.col("prediction"), "max_prob": F.col("probability")})
    return rows.withColumnsRenamed({"__video": "File_Path", "confidence": "Confidence"}).drop("__r", "__folder", "n_frames")


def short_table(results: DataFrame) -> DataFrame:
    return results.select(*SHORT)
