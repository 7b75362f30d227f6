"""Rules by hand: equality of gaps, undated rows, ties, thresholds, sentinels, caps, splits, files and streams."""

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from trailframe.functions import arrays, geometry, paths, times
from trailframe.operators import curation, detections, metrics, scores
from trailframe.operators.encounters import encounters
from trailframe.sources import files
from trailframe.streaming.encounters import stream_encounters

T0 = datetime(2024, 1, 1)


def test_gap_equal_to_the_limit_stays_and_undated_rows_join_the_last(spark):
    rows = [("f", 0, 0.1, "a"), ("f", 30, 0.9, "b"), ("f", 61, 0.2, "c"), ("f", None, 0.8, "d"), ("g", None, 0.5, "e")]
    df = spark.createDataFrame([(f, T0 + timedelta(seconds=s) if s is not None else None, p, x) for f, s, p, x in rows], "folder string, ts timestamp, p double, label string")
    got = {r.label: r.encounter for r in encounters(df, "folder", "ts", "p", "label", "label", 30).collect()}
    assert got == {"a": "b", "b": "b", "c": "d", "d": "d", "e": "e"}
    apart = {r.label: r.encounter for r in encounters(df, "folder", "ts", "p", "label", "label", 30, undated_join=False).collect()}
    assert apart == {"a": "b", "b": "b", "c": "c", "d": "d", "e": "e"}


def test_one_shuffle(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    plan = encounters(df, "user_id", "ts", "value", "event_type", "event_id", 60)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_ties_and_rounding(spark):
    df = spark.createDataFrame([([0.12345, 0.12344, 0.5],)], "p array<double>")
    r = df.select(arrays.ranked(F.col("p"), 4).alias("r"), arrays.argmax(F.array(F.lit(0.5), F.lit(0.5))).alias("a")).first()
    assert [(x["index"], x["value"]) for x in r.r] == [(2, 0.5), (0, 0.1234), (1, 0.1234)] and r.a == 0


def test_sentinel_and_first_of_equal_detections(spark):
    d = [("1", 0.5, [0.1, 0.0, 1.0, 1.0]), ("2", 0.5, [0.2, 0.0, 1.0, 1.0])]
    df = spark.createDataFrame([("a", d), ("b", []), ("c", None)], f"file string, detections array<{detections.DETECTION}>")
    got = {r.file: (r.mega_class, r.confidence) for r in detections.flatten(df).collect()}
    assert got == {"a": (1, 0.5), "b": (-1, -1.0), "c": (-1, -1.0)}
    assert detections.flatten(df, best_only=False).count() == 4


def test_thresholds(spark):
    df = spark.createDataFrame([(0.15,), (0.1,), (None,)], "c double")
    above, below = scores.split_by_confidence(df, "c", 0.15)
    assert (above.count(), below.count()) == (0, 2)


def test_paths(spark):
    df = spark.createDataFrame([("D:\\data\\AB1\\Rats\\x.y.JPG",), ("a/ABC/XYZ/f.jpg",), ("a/b/f",)], "p string")
    p = F.col("p")
    rows = df.select(paths.location_code(p).alias("l"), paths.class_name(p, ["rats"]).alias("c"), paths.class_after_location(p).alias("n"), paths.stem(p).alias("s"), paths.suffix(p).alias("x")).collect()
    assert [tuple(r) for r in rows] == [("AB1", "rats", "Rats", "x.y", ".jpg"), ("unknown", "unknown", "unknown", "f", ".jpg"), ("unknown", "unknown", "unknown", "f", "")]


def test_filters_keep_nulls_and_renames(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert {r.x for r in curation.without(df, "x", ["a"]).collect()} == {"b", None}
    r = df.where("x = 'a'").select(curation.renamed(F.col("x"), {"a": "b", "b": "c"}).alias("one"), curation.renamed_in_turn(F.col("x"), {"a": "b", "b": "c"}).alias("all")).first()
    assert (r.one, r["all"]) == ("b", "c")


def test_split_sizes_and_caps(spark):
    df = spark.range(1003).withColumn("g", F.col("id") % 3)
    sizes = {r["part"]: r["count"] for r in curation.split(df, "id").groupBy("part").count().collect()}
    assert sizes == {"test": 100, "val": 100, "train": 803}
    assert {r["count"] for r in curation.cap_groups(df, ["g"], ["id"], 50).groupBy("g").count().collect()} == {50}


def test_average_precision_of_tied_scores(spark):
    df = spark.createDataFrame([("a", 0.9, 1), ("a", 0.5, 0), ("a", 0.5, 1), ("b", 0.5, 0)], "label string, score double, hit int")
    rows = metrics.average_precision(df, "label", "score", "hit").collect()
    assert [(r.label, r.support, round(r.ap, 6)) for r in rows] == [("a", 2, round(0.5 + 0.5 * 2 / 3, 6))]


def test_geometry_and_times(spark):
    r = spark.range(1).select(F.struct(*[c.alias(k) for k, c in geometry.crop_window(F.lit(0.9), F.lit(0.0), F.lit(0.1), F.lit(0.1), F.lit(1000), F.lit(800), 200).items()]).alias("w"), times.first_format(F.lit("01/02/2023 03:04:05")).alias("t"), times.first_format(F.lit("dt_not_found")).alias("n")).first()
    assert tuple(r.w) == (800, 0, 1000, 200) and r.t == datetime(2023, 2, 1, 3, 4, 5) and r.n is None


def test_files_and_settings(spark, tmp_path):
    (tmp_path / "ABC" / "rat").mkdir(parents=True)
    for name in ("1.JPG", "2.mp4", "3.txt"):
        (tmp_path / "ABC" / "rat" / name).write_bytes(b"x")
    found = files.listing(spark, str(tmp_path))
    assert found.count() == 2
    assert {r.target for r in files.labelled_images(found, ["rat"]).collect()} == {"rat"}
    (tmp_path / "d.json").write_text('{"images": [{"file": "a", "detections": null}], "detection_categories": {"1": "animal"}}')
    assert files.detector_json(spark, str(tmp_path / "d.json")).count() == 1
    assert files.parquet_or_empty(spark, str(tmp_path / "none"), found.schema).count() == 0
    files.write_results(found, str(tmp_path / "out"), ["path"])
    assert files.csv(spark, str(tmp_path / "out")).columns == ["path"]

    @dataclass
    class Defaults:
        limit: int = 1
        names: tuple = ()

    got, odd = files.settings(Defaults(), {"limit": "5", "names": "['a']", "other": 1})
    assert (got.limit, got.names, odd) == (5, ["a"], ["other"])


def test_stream(spark, tmp_path):
    rows = [(1, T0 + timedelta(seconds=s), float(s), f"e{s}") for s in (0, 30, 100)]
    spark.createDataFrame(rows, "u int, ts timestamp, p double, label string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("u int, ts timestamp, p double, label string").parquet(str(tmp_path / "in"))
    q = stream_encounters(stream, "u", "ts", "p", "label", "31 seconds", "1 minute").writeStream.outputMode("complete").format("memory").queryName("s").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    assert sorted((r.n, r.encounter) for r in spark.table("s").collect()) == [(1, "e100"), (2, "e30")]
