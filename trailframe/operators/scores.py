"""Tables of scores: the best three classes, rules for empty images, videos, images without a score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailframe.functions import arrays

EMPTY, NO_BOX, BELOW, UNPROCESSED = "empty", "no_md_box", "below_md_threshold", "unprocessed"


def top_three(df: DataFrame, probs: str, classes: Column, digits: int = 4) -> DataFrame:
    """prediction, probability, second_pred, second_prob, third_pred, third_prob: ranked after rounding to `digits`."""
    df = df.withColumn("__r", arrays.ranked(F.col(probs), digits))
    names = (("prediction", "probability"), ("second_pred", "second_prob"), ("third_pred", "third_prob"))
    out = {}
    for i, (label, value) in enumerate(names):
        best = F.get("__r", F.lit(i))
        out[label], out[value] = F.get(classes, best["index"]), best["value"]
    return df.withColumns(out).drop("__r")


def split_by_confidence(df: DataFrame, confidence: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Rows above the threshold, and rows at or below it; nulls go to neither."""
    return df.where(F.col(confidence) > threshold), df.where(F.col(confidence) <= threshold)


def relabel_empties(df: DataFrame, confidence: str, threshold: float) -> DataFrame:
    """Rows below the threshold: labels become `empty`, probabilities 0."""
    low = F.col(confidence) < threshold
    out = {c: F.when(low, F.lit(EMPTY)).otherwise(F.col(c)) for c in ("prediction", "second_pred", "third_pred")}
    out |= {c: F.when(low, F.lit(0.0)).otherwise(F.col(c)) for c in ("probability", "second_prob", "third_prob")}
    return df.withColumns(out)


def empty_encounters(df: DataFrame, confidence: str, threshold: float, max_prob: str, least: float, markers=(NO_BOX, BELOW)) -> DataFrame:
    """`empty` where both the detector and the encounter are unsure, and for markers of images without a box."""
    unsure = (F.col(confidence) < threshold) & (F.col(max_prob) < least)
    df = df.withColumn("encounter", F.when(unsure, F.lit(EMPTY)).otherwise(F.col("encounter")))
    return df.withColumn("encounter", F.when(F.col("encounter").isin(*markers), F.lit(EMPTY)).otherwise(F.col("encounter")))


def marked_empties(df: DataFrame, confidence: str, label: str) -> DataFrame:
    """Rows that no classifier saw, with what they say instead of a class: no box at all (confidence -1), or one below the threshold."""
    return df.withColumn(label, F.when(F.col(confidence) == -1, F.lit(NO_BOX)).otherwise(F.lit(BELOW)))


def split_videos(df: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows of video frames, and the others; rows without a path go to neither."""
    return df.where(F.col(path).contains("video_")), df.where(~F.col(path).contains("video_"))


def with_unprocessed(expected: DataFrame, scored: DataFrame, key: str, label: str) -> DataFrame:
    """The scored rows, and a row for each expected key without one."""
    missing = expected.select(key).join(scored.select(key), key, "left_anti").withColumn(label, F.lit(UNPROCESSED))
    return scored.unionByName(missing, allowMissingColumns=True)


def assembled(tables: list[DataFrame], key: str) -> DataFrame:
    """The columns of all tables, for keys that each of them has."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, key)
    return out


def video_metadata(df: DataFrame, video: str, frame: str, columns: list[str], confidence: str) -> DataFrame:
    """For each video the first value of each column that isn't null, by frame, and the largest confidence."""
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(frame))).alias(c) for c in columns]
    return df.groupBy(video).agg(*first, F.max(confidence).alias(confidence))


def collapse_videos(df: DataFrame, video: str, frame: str, confidence: str, probs: str, threshold: float = 0.7, columns: list[str] = ()) -> DataFrame:
    """A row for each video: mean probabilities of its frames above the threshold, or of all where there is none; the largest confidence
    of those frames, how many they are, and of those frames the first value of each of `columns` that isn't null, by frame."""
    sure = F.col(confidence) > threshold
    means = df.select(video, sure.alias("__sure"), F.posexplode(probs).alias("i", "p")).groupBy(video, "i")
    means = means.agg(F.coalesce(F.avg(F.when(F.col("__sure"), F.col("p"))), F.avg("p")).alias("p"))
    means = means.groupBy(video).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "p"))), lambda x: x["p"]).alias("probs"))

    def first(column: str, among: Column) -> Column:
        return F.min_by(column, F.when(among & F.col(column).isNotNull(), F.col(frame)))

    def chosen(of) -> Column:
        return F.when(F.count_if(sure) > 0, of(sure)).otherwise(of(F.lit(True)))

    facts = [chosen(lambda among: F.count_if(among)).alias("n_frames"), chosen(lambda among: F.max(F.when(among, F.col(confidence)))).alias("confidence")]
    facts += [chosen(lambda among, c=c: first(c, among)).alias(c) for c in columns]
    return means.join(df.groupBy(video).agg(*facts), video).select(video, "probs", "n_frames", "confidence", *columns)
