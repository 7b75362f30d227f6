"""Many files and many pictures: listings and contents by tasks, values handed on some MB at a time."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trailframe.operators import detections, tensors
from trailframe.plans import tables, videos
from trailframe.sources import files, jpeg, media, photos, shared


class Captured:
    """Stands for a table; keeps the function that Spark would run."""

    def __init__(self, df):
        self.columns, self.schema, self.sparkSession = df.columns, df.schema, df.sparkSession

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def _tree(folder, n):
    for i in range(n):
        path = folder / f"part-{i % 5}" / f"k{i % 3}" / f"{i}{('.JPG', '.mp4', '.txt')[i % 3]}"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(bytes([i % 251]) * (i + 1))
    for hidden in ("_staged-1", ".trash"):
        (folder / hidden).mkdir()
        (folder / hidden / "x.jpg").write_bytes(b"x")


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_tasks_list_and_read(spark, tmp_path, monkeypatch):
    _tree(tmp_path, 60)
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path))
    want = {r.path: (r.modificationTime, r.length, bytes(r.content)) for r in whole.collect()}
    for most in (2, 100):  # folders from which on tasks go all the way down
        monkeypatch.setattr(media, "tasks", lambda spark, most=most: most)
        found = files.listing(spark, str(tmp_path), (".jpg", ".mp4"))
        got = {r.path: (r.modificationTime, r.length) for r in found.collect()}
        assert got == {p: v[:2] for p, v in want.items() if not p.endswith(".txt")} and len(got) == 40
        assert "binaryFile" not in _plan(found)
    monkeypatch.setattr(media, "HELD", 100)
    read = files.contents(spark, f"file://{tmp_path}")
    assert {r.path: bytes(r.content) for r in read.collect()} == {p: v[2] for p, v in want.items() if p.endswith(".JPG")}
    assert "binaryFile" not in _plan(read)
    assert media.listed(spark, str(tmp_path / "part-0" / "k0" / "0.JPG"), (".jpg",)).count() == 1
    assert photos.photo_tags(spark, str(tmp_path)).count() == 20 and "photo_headers" not in _plan(photos.photo_tags(spark, str(tmp_path)))


@pytest.mark.parametrize("query", ["listing", "photo_crops", "photo_pixels"])
def test_no_driver_listing(spark, tmp_path, monkeypatch, query):
    """Spark's own listing of the folder, which the driver holds, is not used."""
    kept = {}
    for module in (tables, videos):
        monkeypatch.setattr(module, "settled", lambda df: kept.setdefault(_plan(df), df) and shared.settled(df))
    plan = getattr(videos if query == "photo_crops" else tables, query)(spark, "/root/testdata/sf0.001")
    assert plan.count() and kept and not any("binaryFile" in p or "InMemoryFileIndex[file:" in p and "scratch" in p for p in kept)


def test_scratch_is_deleted(spark):
    with shared.scratch(spark) as folder:
        inside = media.located(folder)[1]
        photos.write_photos(spark.range(40).select(F.concat(F.lit("a/"), "id", F.lit(".jpg")).alias("path"), F.lit(b"x").alias("content")).repartition(4), f"{folder}/photos")
        assert sum(len(f) for _, _, f in os.walk(inside)) == 40
    assert not os.path.exists(inside)


def test_pieces(monkeypatch):
    monkeypatch.setattr(media, "HELD", 10)
    batch = pa.RecordBatch.from_pydict({"i": list(range(7))})
    got = [(rows.column(0).to_pylist(), made) for rows, made in media.pieces(batch, iter([b"1234", None, b"123456", b"x" * 30, b"", None, b"1"]))]
    assert got == [([0, 1, 2], [b"1234", None, b"123456"]), ([3], [b"x" * 30]), ([4, 5, 6], [b"", None, b"1"])]
    assert list(media.pieces(batch.slice(0, 0), iter([]))) == []


def test_code_tables_of_few_bits(monkeypatch):
    """A small photo's codes are looked up in tables of few bits; both ways of reading give the same pixels, at any quality."""
    r = np.random.default_rng(2)
    for shape in ((12, 13, 3), (40, 50, 3), (200, 300, 3)):
        for quality in (30, 75, 90, 100):
            image = r.integers(0, 256, shape).astype(np.uint8)
            data = jpeg.encode(image, quality)
            monkeypatch.setattr(jpeg, "LARGE", 1 << 40)
            small = jpeg.decode(data)
            monkeypatch.setattr(jpeg, "LARGE", -1)
            assert (jpeg.decode(data) == small).all() and (quality < 100 or np.abs(small.astype(int) - image).max() <= 3)
    monkeypatch.undo()
    widths, codes = [], jpeg._codes
    monkeypatch.setattr(jpeg, "_codes", lambda *a: widths.append(a[3]) or codes(*a))
    jpeg.decode(jpeg.encode(np.full((12, 12, 3), 90, np.uint8)))
    assert set(widths) == {8}


def test_small_photos_together(monkeypatch):
    """Small photos of one shape are transformed in few steps, and are to the byte and the pixel what they are one by one."""
    r = np.random.default_rng(4)
    images = [r.integers(0, 256, ((12, 13, 3), (24, 24, 3), (9, 40, 3))[i % 3]).astype(np.uint8) // (1 + 40 * (i % 2)) for i in range(300)]
    images[7] = images[8] = None
    calls, pixels, encode = [], jpeg._pixels, jpeg._encode
    monkeypatch.setattr(jpeg, "_pixels", lambda *a: calls.append("decode") or pixels(*a))
    monkeypatch.setattr(jpeg, "_encode", lambda *a: calls.append("encode") or encode(*a))
    data = list(jpeg.encoded(images, 90))
    mixed = [b"broken", data[0][:-60], None, *data]
    found = list(jpeg.decoded(mixed))
    assert calls == ["encode"] * 3 + ["decode"] * 3
    assert data == [None if x is None else jpeg.encode(x, 90) for x in images]
    assert found[:3] == [None] * 3 and all(a is b is None or (jpeg.decode(b) == a).all() for a, b in zip(found[3:], data, strict=True))
    for most in (1, 1000):
        monkeypatch.setattr(jpeg, "TOGETHER", most)
        assert list(jpeg.encoded(iter(images), 90)) == data and [x is None for x in jpeg.decoded(mixed)] == [x is None for x in found]
    assert list(jpeg.decoded([])) == list(jpeg.encoded([])) == []


def test_contents_are_not_shuffled(spark, tmp_path, monkeypatch):
    """Names are joined with the listing; files are read behind that, and what is read stays in its task until it is written."""
    kept = []
    monkeypatch.setattr(videos, "settled", lambda df: kept.append(_plan(df).split("== Physical Plan ==")[1]) or shared.settled(df))
    videos.photo_crops(spark, "/root/testdata/sf0.001")
    assert len(kept) == 2
    for plan in kept:
        lines = [x for x in plan.splitlines() if "MapInArrow" in x or "Exchange" in x or "Join" in x]
        first = next(i for i, x in enumerate(lines) if "Exchange" in x or "Join" in x)
        assert sum("MapInArrow" in x for x in lines[:first]) >= 3 and not any("content" in x for x in lines[first:])
    _tree(tmp_path, 60)
    beside = spark.createDataFrame([("3.JPG", 1), ("30.JPG", 2), ("31.mp4", 3), ("gone.jpg", 4)], "name string, n int")
    found = files.contents(spark, str(tmp_path), beside=beside).collect()
    assert {(r.name, r.n, len(r.content)) for r in found} == {("3.JPG", 1, 4), ("30.JPG", 2, 31)}


def test_headers_of_cut_photos(spark, tmp_path):
    """Photos that are cut behind 200 KB of other segments and their header."""
    names = spark.createDataFrame([(k, "A") for k in (1950, 3900, 650, 50, 13)], "c_custkey long, c_mktsegment string")
    names.write.parquet(str(tmp_path / "customer.parquet"))
    rows = {r.File_Path: r for r in tables.photo_headers(spark, str(tmp_path)).collect()}
    for k in (1950, 3900):
        assert rows[f"A/{k}.JPG"].Date_Time == "2020:2:2 2:02:02" and rows[f"A/{k}.JPG"].few_bytes
    assert rows["A/1950.JPG"].Description == "camera2" and len(rows) == 5
    assert tables.photo_pixels(spark, str(tmp_path)).select("path").collect() == [("A/50.JPG",)]


def test_pictures_go_on_together(spark):
    """One batch in, one batch out: not one for each picture."""
    df = spark.createDataFrame([(i, 2, 3, bytes(18) if i % 4 else None, 1.0) for i in range(50)], "id long, image_width int, image_height int, pixels binary, s double")
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(50)), "image_width": pa.array([2] * 50, pa.int32()), "image_height": pa.array([3] * 50, pa.int32()), "pixels": pa.array([bytes(18) if i % 4 else None for i in range(50)], pa.binary()), "s": pa.array([1.0] * 50)})
    turned = Captured(df)
    tensors.changed(turned, lambda image, s: np.full((3 + int(s), 5, 3), 7, np.uint8), "s")
    (out,) = turned.run([batch])
    assert out.column("image_width").to_pylist() == [5 if i % 4 else 2 for i in range(50)] and out.column("image_height").to_pylist() == [4 if i % 4 else 3 for i in range(50)]
    assert out.column("pixels").to_pylist() == [b"\7" * 60 if i % 4 else None for i in range(50)] and out.schema == batch.schema
    flat = Captured(df)
    tensors.tensors(flat)
    (out,) = flat.run([batch])
    assert [v if v is None else len(v) for v in out.column("tensor").to_pylist()] == [18 if i % 4 else None for i in range(50)]


def test_videos_are_made_in_pieces(spark, tmp_path, monkeypatch):
    spark.range(1, 400).select(F.col("id").alias("s_suppkey"), F.lit(1).alias("s_nationkey")).coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    monkeypatch.setattr(media, "HELD", 1 << 18)
    seen = []
    own = type(spark.range(1)).mapInArrow
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda df, run, schema, *a: seen.append(run) or own(df, run, schema, *a))
    videos._supplier_videos(spark, str(tmp_path))
    batch = pa.RecordBatch.from_pydict({"path": [str(k) for k in range(1, 400)], "k": list(range(1, 400))})
    sizes = [sum(map(len, b.column("content").to_pylist())) for b in seen[-1]([batch])]
    assert len(sizes) > 10 and max(sizes) < (1 << 18) + 200_000


def test_document_by_lines(spark, tmp_path, monkeypatch):
    """A document's parts, read by lines, hold what the reader of whole documents finds in them put together."""
    rows = spark.range(300).select((F.col("id") * 7919 % 1000).alias("file"), (F.col("id") % 3).cast("int").alias("category"), (F.col("id") / 300).alias("conf"), F.array(*[F.lit(0.1)] * 4).alias("bbox"))
    labels = F.array(F.lit("a]}"), F.lit("detections"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        detections.write_document(rows, labels, str(tmp_path / "parts"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    parts = sorted((tmp_path / "parts").glob("part-*"))
    assert len(parts) > 1
    (tmp_path / "whole.json").write_text("".join(p.read_text() for p in parts))
    images, names = files.detector_lines(spark, str(tmp_path / "parts"))
    key = lambda r: r.file
    assert sorted(images.collect(), key=key) == sorted(files.detector_json(spark, str(tmp_path / "whole.json")).collect(), key=key)
    assert sorted(names.collect()) == [("1", "a]}"), ("2", "detections"), ("3", "empty")]
    kept = []
    monkeypatch.setattr(tables, "settled", lambda df: kept.append(_plan(df)) or shared.settled(df))
    assert tables.detector_document(spark, "/root/testdata/sf0.001").count() and kept and "FileScan json" not in kept[0]
