"""Values worked out by hand: crops, scales, weights, schedules, formats, headers, whole tables and the command line."""

import json
import math
import os
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailframe import __main__ as command
from trailframe.functions import arrays, geometry, schedules, times
from trailframe.operators import curation, detections, inference, metrics, results, sampling, scores
from trailframe.operators.encounters import encounters, encounters_by_span
from trailframe.sources import files, photos, shared


def one(spark, **columns):
    return tuple(spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first())


def window(spark, box, image, size, inside=False):
    return one(spark, **geometry.crop_window(*[F.lit(float(v)) for v in box], *[F.lit(v) for v in image], size, inside))


def test_crop_windows(spark):
    # the side stays 300 for a box of 800 pixels: centre 500, 500
    assert window(spark, (0.1, 0.1, 0.8, 0.8), (1000, 1000), 300) == (350, 350, 650, 650)
    # centre 100: -50 to 250 stands over both edges of an image of 200
    assert window(spark, (0, 0, 1, 1), (200, 200), 300) == (0, 0, 300, 300)
    assert window(spark, (0, 0, 1, 1), (200, 200), 300, True) == (0, 0, 200, 200)
    # centre 10, 990: moved right by 140 and up by 140
    assert window(spark, (0.0, 0.98, 0.02, 0.02), (1000, 1000), 300) == (0, 700, 300, 1000)
    # an image of 200, centre 199: 49 to 349 stands over one edge only, so it moves to -100
    assert window(spark, (0.99, 0.4, 0.01, 0.2), (200, 1000), 300)[::2] == (-100, 200)
    assert window(spark, (0.99, 0.4, 0.01, 0.2), (200, 1000), 300, True)[::2] == (0, 200)
    # starts are cut towards zero: 149.6 - 150 is 0, not -1
    assert window(spark, (0.1486, 0.5, 0.002, 0.1), (1000, 1000), 300)[0] == 0


def test_scales(spark):
    def scale(box, image, buffer, size):
        return one(spark, s=geometry.new_scale(*[F.lit(float(v)) for v in box], *[F.lit(v) for v in image], buffer, size))[0]

    assert scale((0.1, 0.2, 0.8, 0.5), (1000, 1000), 0.05, 300) == pytest.approx(300 / 900)  # 0.05 to 0.95
    assert scale((0.0, 0.2, 0.98, 0.5), (1000, 1000), 0.1, 300) == pytest.approx(0.3)  # cut to 0 and 1
    assert scale((0.4, 0.4, 0.1, 0.1), (1000, 1000), 0.05, 300) is None
    assert one(spark, a=geometry.scaled_side(F.lit(1001), F.lit(0.5)), b=geometry.scaled_side(F.lit(7), F.lit(None).cast("double"))) == (500, 7)
    text = geometry.as_text(F.array(*[F.lit(v) for v in (0.0, 0.0005, -0.5, 1.0, 0.1234)]), 5)
    assert one(spark, t=text)[0] == "[0.0, 0.0005, -0.5, 1.0, 0.1234]"


def test_weights(spark):
    rows = spark.createDataFrame([("a",)] * 9 + [("b",)], "x string")
    got = {r.x: r for r in curation.class_weights(rows, "x").collect()}
    # roots 3 and 1, their mean 2
    assert [got["a"].root_weight, got["b"].root_weight] == pytest.approx([2 / 3, 2.0])
    assert [got["a"].weight, got["b"].weight] == pytest.approx([5 / 9, 5.0]) and got["a"].sampling_weight == pytest.approx(1 / 3)


def test_learning_rate(spark):
    rate = schedules.learning_rate(F.col("id"), 0.01, 0.001, 0.0001, 2, 4, 0.5)
    got = [r[0] for r in spark.range(8).select(rate).collect()]
    # 0.1 to 1 in two epochs; then cosines between 1 and 0.01, halved from the fifth epoch after the warm-up
    cosine = [0.01 + 0.99 * (1 + math.cos(math.pi * k / 4)) / 2 for k in range(4)]
    assert got == pytest.approx([0.001, 0.0055, 0.01, 0.01 * cosine[1], 0.01 * cosine[2], 0.01 * cosine[3], 0.005, 0.005 * cosine[1]])


def test_frame_steps(spark):
    rows = spark.createDataFrame([(900, 30.0), (5, 30.0), (1, 30.0), (0, 30.0), (301, 30.0), (3, 1.0)], "total long, fps double")
    rows = rows.withColumn("step", schedules.frame_step(F.col("total"), F.col("fps"), 0.5, 20)).withColumn("frames", schedules.frame_numbers(F.col("total"), F.col("step")))
    got = [(r.step, len(r.frames)) for r in rows.collect()]
    # 900 // 15 = 60 is over 20, so 900 // 20; 5 is less than 15, so 4; one frame; none; 301 // 15 = 20 stays; 0 frames in half a second
    assert got == [(45, 20), (4, 2), (1, 1), (1, 0), (15, 21), (1, 3)]


def test_formats(spark):
    texts = ["2023:05:06 07:08:09", "23:05:06 07:08:09", "06/05/2023 07:08:09", "2023-05-06 07:08:09", "95:05:06 07:08:09", "dt_not_found", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in rows.select(times.result_text(F.col("t"))).collect()] == ["06/05/2023 07:08:09"] * 3 + [None, "06/05/1995 07:08:09", None, None]


def test_missing_and_unparseable_dates_differ(spark):
    rows = [("f", "01/01/2024 00:00:00", 0.5, "cat"), ("f", "nonsense", 0.2, "dog"), ("f", None, 0.3, "rat")]
    df = spark.createDataFrame(rows, "folder string, said string, p double, label string")
    df = df.withColumn("ts", F.try_to_timestamp("said", F.lit(times.RESULT)))
    got = {r.label: (r.encounter, r.max_prob) for r in encounters(df, "folder", "ts", "p", "label", "label", 30, text="said").collect()}
    assert got == {"cat": ("cat", 0.5), "dog": ("cat", 0.5), "rat": ("rat", 0.3)}


def test_spans_give_the_same_encounters(spark):
    r = random.Random(3)
    rows = [(r.choice(("a", "b", None)), None if r.random() < 0.1 else r.randint(0, 3000), r.choice((None, 0.1, 0.5, 0.9)), f"k{k}") for k in range(400)]
    rows += [("long", 10 * k, 0.2, f"l{k}") for k in range(300)] + [("undated", None, 0.3, "u")]
    df = spark.createDataFrame(rows, "folder string, t long, p double, label string").withColumn("ts", F.timestamp_seconds(F.col("t") + 1_700_000_000)).drop("t")
    want = encounters(df, "folder", "ts", "p", "label", "label", 30)
    for span in (7, 60, 100_000):
        got = encounters_by_span(df, "folder", "ts", "p", "label", "label", 30, span)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_video_metadata_comes_from_the_confident_frames(spark):
    rows = [("v", 1, 0.2, [0.9, 0.1], "low"), ("v", 2, 0.8, [0.2, 0.8], None), ("v", 3, 0.9, [0.4, 0.6], "high"), ("w", 1, 0.1, [0.6, 0.4], "only")]
    df = spark.createDataFrame(rows, "video string, frame int, conf double, probs array<double>, note string")
    got = {r.video: (r.probs, r.n_frames, r.confidence, r.note) for r in scores.collapse_videos(df, "video", "frame", "conf", "probs", 0.7, ["note"]).collect()}
    assert got["v"] == (pytest.approx([0.3, 0.7]), 2, 0.9, "high") and got["w"] == ([0.6, 0.4], 1, 0.1, "only")


def test_newest_has_no_ties(spark):
    rows = [("a", 1, "x", 1), ("a", 2, "p", 2), ("a", 2, "q", 1)]
    df = spark.createDataFrame(rows, "k string, t int, name string, n int")
    assert [tuple(r) for r in detections.newest(df.repartition(3), "k", "t").collect()] == [("a", 2, "q", 1)]
    assert [tuple(r) for r in detections.newest(df.repartition(3), "k", "t", "n").collect()] == [("a", 2, "p", 2)]


def test_caps_with_null_groups(spark):
    df = spark.createDataFrame([(None, i) for i in range(9)] + [("a", i) for i in range(3)], "g string, k int")
    got = curation.cap_groups_adaptive(df, ["g"], ["k"], 4, 8).groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in got} == {None: 6, "a": 3}  # 4 + (9 - 4) // 2


def test_document_is_json(spark, tmp_path):
    boxes = [("1", 0.2, [0.0, 0.0, 0.5, 0.5]), ("1", 0.7, [0.1, 0.2, 0.3, 0.4])]
    images = spark.createDataFrame([("b.jpg", boxes), ("a.jpg", []), ("c.jpg", None), ("d.jpg", boxes)], f"file string, detections array<{detections.DETECTION}>")
    said = spark.createDataFrame([("a.jpg", "cat", 0.5), ("b.jpg", "cat", 0.75), ("c.jpg", "other", 0.1)], "file string, encounter string, max_prob double")
    names = F.array(F.lit("dog"), F.lit("cat"))
    detections.write_document(detections.replaced(images, said, names), names, str(tmp_path / "out"))
    parts = sorted(f for f in os.listdir(tmp_path / "out") if f.startswith("part-"))
    document = json.loads("".join((tmp_path / "out" / f).read_text() for f in parts))
    assert document["detection_categories"] == {"1": "cat", "2": "dog", "3": "empty"}
    assert [(x["file"], x["detections"]) for x in document["images"]] == [
        ("a.jpg", [{"category": 1, "conf": 0.5, "bbox": [0.0, 0.0, 1.0, 1.0]}]), ("b.jpg", [{"category": 1, "conf": 0.75, "bbox": [0.1, 0.2, 0.3, 0.4]}]), ("c.jpg", [{"category": 0, "conf": 0.1, "bbox": [0.0, 0.0, 1.0, 1.0]}]),
    ]


def test_model_from_outside(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, None)], "id int, x double")

    def load():
        return lambda batch: np.stack([np.zeros(batch.num_rows), batch.column("x").to_numpy()], 1)

    got = {r.id: r.probs for r in inference.classify(df, ["x"], load).collect()}
    assert got == {1: [0.5, 0.5], 2: pytest.approx([1 / (1 + math.e), math.e / (1 + math.e)])}
    assert inference.classify(df.limit(0), ["x"], load).collect() == []
    with pytest.raises(Exception, match="shape"):
        inference.classify(df, ["x"], lambda: lambda batch: np.zeros(3)).collect()


def _tags(data):
    return photos.tags(photos.in_memory(data))


def test_headers():
    assert _tags(b"\xff\xd8" + photos.header("2021:01:01 00:00:00", "2020:01:01 00:00:00", "a__b") + b"\xff\xd9") == ("2020:01:01 00:00:00", "2021:01:01 00:00:00", "a__b", True, True)
    assert _tags(b"\xff\xd8\xff\xe1" + struct.pack(">H", 12) + b"Exif\0\0XX\0\0") == (None, None, None, False, True)
    assert _tags(b"\xff\xd8\xff\xd9") == (None, None, None, False, True)
    assert _tags(b"") == _tags(b"GIF89a") == (None, None, None, False, False)


def test_smallest_with_ties_and_nulls(spark):
    r = random.Random(5)
    values = [None if r.random() < 0.05 else 0.0 if r.random() < 0.4 else r.random() for _ in range(5000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v double").repartition(3)
    ranked = sorted(range(5000), key=lambda i: (values[i] is None, values[i] or 0.0, i))
    for n in (0, 1, 700, 2500, 4990, 5000, 9000):
        assert sorted(x.id for x in curation.smallest(df, "v", "id", n).collect()) == sorted(ranked[:n])
    assert curation.smallest(df.limit(0), "v", "id", 5).collect() == []
    weighted = curation.weighted_sample(spark.range(100), "id", F.when(F.col("id") < 50, F.col("id").cast("double")), 60).collect()
    assert {x.id for x in weighted} == {*range(50), *range(50, 60), 0}


def test_min_max_scaled(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (1, None), (None, 7.0), (2, 5.0), (2, 5.0)], "g int, x double")
    got = sorted(map(str, (tuple(r) for r in curation.min_max_scaled(df, ["g"], "x", "s").collect())))
    assert got == sorted(map(str, [(1, 2.0, 0.0), (1, 4.0, 1.0), (1, None, None), (None, 7.0, 0.0), (2, 5.0, 0.0), (2, 5.0, 0.0)]))


def test_one_digit_dates(spark):
    texts = {"2023:5:6 7:08:9": "06/05/2023 07:08:09", "6/5/2023 07:08:09": "06/05/2023 07:08:09", "23:12:1  1:2:3": "01/12/2023 01:02:03", "2023:05:06 07:08:09": "06/05/2023 07:08:09",
             "2023:5:6 7:8": None, "2023:5:6 7:8:9 ": None, " 2023:5:6 7:8:9": None, "2023:13:6 7:8:9": None, "2023:2:30 7:8:9": None, "123:5:6 7:8:9": None, "2023:005:6 7:8:9": None, "70:1:2 3:4:5": "02/01/1970 03:04:05", "": None, None: None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.x for r in df.select("t", times.result_text(F.col("t")).alias("x")).collect()} == texts


def test_sample_needs_rows(spark):
    with pytest.raises(ValueError, match="500"):
        sampling.sample_rows(spark.range(499), "id")
    assert sampling.sample_rows(spark.range(501), "id").count() == 500


def test_small_helpers(spark):
    assert metrics.throughput(10, 4) == 2.5 and metrics.throughput(10, 0) == 0.0
    assert curation.inverted({"finch": ["greenfinch", "goldfinch"]}) == {"greenfinch": "finch", "goldfinch": "finch"}
    assert one(spark, i=arrays.hot_index(F.array(F.lit(0), F.lit(1))), f=arrays.flattened(F.array(F.array(F.lit(1)), F.array(F.lit(2), F.lit(3))))) == (1, [1, 2, 3])
    approximate = metrics.described_columns(spark.range(1, 102), exact=False).first()
    assert (approximate.column, approximate.n, approximate.middle) == ("id", 101, 51.0)


def test_scratch_goes(spark):
    with shared.scratch(spark) as folder:
        spark.range(3).write.parquet(folder + "/x")
        assert os.path.isdir(folder.removeprefix("file:"))
    assert not os.path.exists(folder.removeprefix("file:"))


def test_command_line(spark, tmp_path):
    document = {"images": [{"file": "c/a.jpg", "detections": [{"category": "1", "conf": 0.9, "bbox": [0.1, 0.1, 0.2, 0.2]}]}, {"file": "c/b.jpg", "detections": []}, {"file": "c/z.jpg"}], "detection_categories": {"1": "animal"}}
    (tmp_path / "md.json").write_text(json.dumps(document))
    (tmp_path / "settings.yaml").write_text("CLASSES: \"['cat', 'dog']\"\nNOBODY: 1\n")
    rows = [("c/a.jpg", "cat", "01/01/2024 00:00:00", "[]", [0.2, 0.8]), ("c/b.jpg", "cat", "01/01/2024 00:00:10", "[]", [0.6, 0.4])]
    spark.createDataFrame(rows, "File_Path string, Targets string, Date_Time string, Crop string, probs array<double>").write.parquet(str(tmp_path / "scores.parquet"))
    cfg, unknown = files.read_settings(spark, str(tmp_path / "settings.yaml"), command.Settings())
    assert cfg.CLASSES == ["cat", "dog"] and unknown == ["NOBODY"]
    command.infer(spark, str(tmp_path), cfg)
    short = {r.File_Path: (r.Encounter, r.Max_Prob) for r in files.csv(spark, str(tmp_path / "predictions")).collect()}
    # b has no box, so it is empty; but it stands in a's encounter
    assert short == {"c/a.jpg": ("dog", 0.8), "c/b.jpg": ("dog", 0.8), "c/z.jpg": ("unprocessed", None)}
    full = files.csv(spark, str(tmp_path / "predictions_full"))
    assert full.columns == [*results.FULL, "cat", "dog"] and full.where("File_Path = 'c/b.jpg'").first().Prediction == "empty"
