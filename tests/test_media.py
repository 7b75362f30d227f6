"""Photos and videos as files: headers by ranges, pixels, frames' tables, and files written under a commit."""

import os
import struct
import types

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trailframe.plans.videos import avi, mp4
from trailframe.sources import files, jpeg, media, photos, videos

Y_TABLE, C_TABLE = np.arange(1, 65) % 7 + 1, np.arange(1, 65) % 5 + 2


def slow_jpeg(image, h, v, restart=0, grey=False):
    """An encoder by the standard's text, with bits as a string: h x v samples of brightness to one of colour, 8 bits for every symbol."""
    zigzag = []
    for s in range(15):
        diagonal = [(i, s - i) for i in range(8) if 0 <= s - i < 8]
        zigzag += diagonal if s % 2 else diagonal[::-1]
    height, width = image.shape[:2]
    x = image.astype(float)
    y = 0.299 * x[..., 0] + 0.587 * x[..., 1] + 0.114 * x[..., 2]
    planes = [y] if grey else [y, 128 + (x[..., 2] - y) / 1.772, 128 + (x[..., 0] - y) / 1.402]
    down, across = -(-height // (8 * v)), -(-width // (8 * h))
    planes = [np.pad(p, ((0, down * 8 * v - height), (0, across * 8 * h - width)), mode="edge") for p in planes]
    planes = [planes[0], *[p.reshape(down * 8, v, across * 8, h).mean((1, 3)) for p in planes[1:]]]
    symbols = sorted({*range(12)} | {r << 4 | s for r in range(16) for s in range(1, 11)} | {0, 0xF0})
    code = {s: format(i, "08b") for i, s in enumerate(symbols)}
    dct = np.array([[(np.sqrt(1 / 8) if u == 0 else 0.5) * np.cos((2 * i + 1) * u * np.pi / 16) for i in range(8)] for u in range(8)])

    def value(n):
        size = int(abs(n)).bit_length()
        return size, format(n if n > 0 else n + (1 << size) - 1, f"0{size}b") if size else ""

    scan, bits, last, units = b"", "", [0, 0, 0], 0

    def flushed(bits):
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")

    for my in range(down):
        for mx in range(across):
            for c, p in enumerate(planes):
                hh, vv = (h, v) if c == 0 else (1, 1)
                for by in range(vv):
                    for bx in range(hh):
                        at = ((my * vv + by) * 8, (mx * hh + bx) * 8)
                        f = dct @ (p[at[0] : at[0] + 8, at[1] : at[1] + 8] - 128) @ dct.T
                        table = Y_TABLE if c == 0 else C_TABLE
                        q = [int(np.round(f[i, j] / table[k])) for k, (i, j) in enumerate(zigzag)]
                        size, text = value(q[0] - last[c])
                        last[c] = q[0]
                        bits += code[size] + text
                        run = 0
                        for n in q[1:]:
                            if n == 0:
                                run += 1
                                continue
                            while run > 15:
                                bits, run = bits + code[0xF0], run - 16
                            size, text = value(n)
                            bits, run = bits + code[run << 4 | size] + text, 0
                        bits += code[0] if run else ""
            units += 1
            if restart and units % restart == 0 and units < down * across:
                scan, bits, last = scan + flushed(bits) + bytes([0xFF, 0xD0 + (units // restart - 1) % 8]), "", [0, 0, 0]
    scan += flushed(bits)

    def segment(marker, content):
        return struct.pack(">BBH", 0xFF, marker, len(content) + 2) + content

    counts = bytes([0] * 7 + [len(symbols)] + [0] * 8) + bytes(symbols)
    n = len(planes)
    parts = [b"\xff\xd8", segment(0xDB, b"\0" + bytes(Y_TABLE.tolist()) + b"\1" + bytes(C_TABLE.tolist()))]
    parts.append(segment(0xC0, struct.pack(">BHHB", 8, height, width, n) + b"".join(bytes([c + 1, (h << 4 | v) if c == 0 else 0x11, c > 0]) for c in range(n))))
    parts += [segment(0xC4, bytes([t]) + counts) for t in (0x00, 0x10)] + [segment(0xDD, struct.pack(">H", restart))]
    return b"".join([*parts, segment(0xDA, bytes([n]) + b"".join(bytes([c + 1, 0]) for c in range(n)) + bytes([0, 63, 0])), scan, b"\xff\xd9"])


def smooth(height, width):
    y, x = np.mgrid[:height, :width]
    return np.stack([x * 3 % 256, 200 - y * 2 % 200, 90 + x + y], -1).clip(0, 255).astype(np.uint8)


@pytest.mark.parametrize(("h", "v", "restart"), [(1, 1, 0), (2, 1, 0), (2, 2, 0), (2, 2, 3), (1, 1, 1), (1, 2, 2)])
def test_decode_other_encoders(h, v, restart):
    image = np.full((37, 53, 3), 120, np.uint8)
    image[..., 0] += np.arange(53, dtype=np.uint8)
    image[16:32, 16:48] = [200, 60, 90]
    got = jpeg.decode(slow_jpeg(image, h, v, restart)).astype(int)
    assert got.shape == image.shape
    assert np.abs(got - image)[18:30, 20:44].max() <= 6 and np.abs(got - image).mean() < 4
    if (h, v) == (1, 1):
        assert np.abs(got - image).max() <= 12


def test_decode_flat_colours_and_grey():
    for colour in ([0, 0, 0], [255, 255, 255], [250, 3, 128], [13, 200, 77]):
        image = np.full((20, 30, 3), colour, np.uint8)
        for data in (slow_jpeg(image, 2, 2), jpeg.encode(image), jpeg.encode(image, 60)):
            assert np.abs(jpeg.decode(data).astype(int) - colour).max() <= (2 if data != jpeg.encode(image, 60) else 8)
    grey = jpeg.decode(slow_jpeg(np.full((9, 9, 3), 77, np.uint8), 1, 1, grey=True))
    assert grey.shape == (9, 9, 3) and np.abs(grey.astype(int) - 77).max() <= 2


def test_round_trip():
    r = np.random.default_rng(0)
    for image in (smooth(40, 50), r.integers(0, 256, (33, 17, 3)).astype(np.uint8), smooth(1, 1)):
        assert np.abs(jpeg.decode(jpeg.encode(image, 100)).astype(int) - image).max() <= 3
    assert np.abs(jpeg.decode(jpeg.encode(smooth(64, 64), 95)).astype(int) - smooth(64, 64)).mean() < 2


def test_damaged():
    data = jpeg.encode(smooth(64, 64))
    for bad in (b"", b"GIF89a", data[:2], data[:40], data[: len(data) // 2], data[:-200], data.replace(b"\xff\xc0", b"\xff\xc2"), b"\xff\xd8" + bytes(50), data[:2] + data[-2:]):
        with pytest.raises(jpeg.Damaged):
            jpeg.decode(bad)
    r = np.random.default_rng(1)
    for _ in range(200):  # any bytes at all end in pixels or in Damaged
        broken = bytearray(data)
        for at in r.integers(2, len(data), 5):
            broken[at] = r.integers(0, 256)
        try:
            jpeg.decode(bytes(broken))
        except jpeg.Damaged:
            pass


def test_header_after_many_segments(spark, tmp_path):
    """200 KB of segments before the header of one photo, 20 MB of picture behind that of another; few bytes are read of both."""
    tags = photos.header("2024:05:06 07:08:09", "2020:01:01 00:00:00", "cam__site")
    filler = (b"\xff\xe2" + struct.pack(">H", 65002) + bytes(65000)) * 3 + b"\xff\xff\xfe" + struct.pack(">H", 7002) + bytes(7000)
    for name, data in (("a.jpg", b"\xff\xd8" + filler + tags + b"\xff\xd9"), ("b.JPEG", b"\xff\xd8" + tags + b"\xff\xda\0\2" + bytes(20_000_000)), ("c.jpg", b""), ("d.png", b"\xff\xd8" + tags)):
        (tmp_path / name).write_bytes(data)
    rows = {r.path.rsplit("/", 1)[1]: r for r in photos.photo_tags(spark, str(tmp_path)).collect()}
    whole = {r.path.rsplit("/", 1)[1]: r for r in photos._whole_files(spark, str(tmp_path), (".jpg", ".jpeg")).collect()}
    assert set(rows) == {"a.jpg", "b.JPEG", "c.jpg"} and set(whole) == {"a.jpg", "b.JPEG"}  # Spark leaves empty files out
    for name in whole:
        assert rows[name][:7] == whole[name][:7]
    for name in ("a.jpg", "b.JPEG"):
        assert rows[name].original == "2024:05:06 07:08:09" and rows[name].description == "cam__site" and rows[name].bytes_read < 65536
    assert not rows["c.jpg"].readable


def test_only_new_files_are_read(spark, tmp_path):
    tags = lambda t: b"\xff\xd8" + photos.header(original=t, description="d") + b"\xff\xd9"
    for i in range(6):
        (tmp_path / f"{i}.jpg").write_bytes(tags(f"2024:01:0{i + 1} 00:00:00"))
    read = []

    def scan(wanted):
        listed = files.listing(spark, str(tmp_path), (".jpg",))
        new = listed.join(wanted.select(F.col("File_Path").alias("path")), "path", "left_semi")
        read.append(new.count())
        return photos.cached_tags(photos.tags_of(new))

    every = files.listing(spark, str(tmp_path), (".jpg",)).select(F.col("path").alias("File_Path"))
    cache = photos.refreshed(spark.createDataFrame([], "File_Path string, Date_Time string, Description string"), every, scan)
    cache = spark.createDataFrame(cache.collect(), cache.schema)
    (tmp_path / "6.jpg").write_bytes(tags("2024:01:07 00:00:00"))
    (tmp_path / "0.jpg").unlink()
    every = files.listing(spark, str(tmp_path), (".jpg",)).select(F.col("path").alias("File_Path"))
    rows = photos.refreshed(cache, every, scan).collect()
    assert read == [6, 1] and sorted(r.Date_Time for r in rows) == [f"2024:01:0{i + 1} 00:00:00" for i in range(1, 7)]
    gone = photos.tags_of(spark.createDataFrame([(f"file:{tmp_path}/none.jpg", 5)], "path string, length long")).first()
    assert not gone.readable and gone.bytes_read == 0


def test_another_decoder(spark):
    df = spark.createDataFrame([(1, b"ok"), (2, b"no"), (3, None)], "id int, content binary")

    def plain(data):
        if data != b"ok":
            raise ValueError("no")
        return np.full((1, 2, 3), 7, np.uint8)

    got = {r.id: (r.image_width, r.pixels and bytes(r.pixels)) for r in photos.decoded(df, decode=plain).collect()}
    assert got == {1: (2, b"\7" * 6), 2: (None, None), 3: (None, None)}


def test_files_are_dealt_by_what_is_read(tmp_path):
    for i in range(10):
        (tmp_path / f"{i}.jpg").write_bytes(bytes(100))
    reader = media.HeaderReader({"path": str(tmp_path), "taskBytes": str(3 * media.OPENING)}, ".jpg")
    assert [len(p.files) for p in reader.partitions()] == [3, 3, 3, 1]
    (tmp_path / "none").mkdir()
    assert [p.files for p in media.HeaderReader({"path": str(tmp_path / "none")}, ".jpg").partitions()] == [[]]


def test_header_takes_the_old_ones_place():
    data = jpeg.encode(smooth(9, 9))
    once = photos.with_header(data, original="2024:01:01 00:00:00", description="x")
    twice = photos.with_header(once, changed="2025:01:01 00:00:00")
    assert photos.tags(photos.in_memory(once)) == (None, "2024:01:01 00:00:00", "x", True, True)
    assert photos.tags(photos.in_memory(twice)) == ("2025:01:01 00:00:00", None, None, True, True)
    assert twice.count(b"Exif\0\0") == 1 and (jpeg.decode(twice) == jpeg.decode(data)).all()
    with pytest.raises(ValueError, match="no JPEG"):
        photos.with_header(b"GIF")
    with pytest.raises(ValueError, match="too long"):
        photos.with_header(data, description="x" * 70_000)


def test_write_and_read_photos(spark, tmp_path):
    rows = [("a/1.jpg", jpeg.encode(np.full((8, 9, 3), 90, np.uint8))), ("a/2.jpg", b"broken"), ("3.jpg", None), (None, b"x")]
    df = spark.createDataFrame(rows, "path string, content binary").repartition(3)
    folder = str(tmp_path / "out")
    photos.write_photos(df, folder)
    names = lambda: sorted(f"{os.path.basename(d)}/{f}" for d, _, files in os.walk(folder) for f in files)
    assert [n.split("/")[1] for n in names()] == ["1.jpg", "2.jpg"] and not [d for d in os.listdir(folder) if d.startswith("_")]
    photos.write_photos(df.limit(0), folder)
    assert len(names()) == 2
    photos.write_photos(df, folder, mode="overwrite")
    assert len(names()) == 2
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "content")
    kept, seen = photos.decodable(photos.decoded(read))
    got = kept.collect()
    assert [(r.image_width, r.image_height, set(r.pixels)) for r in got] == [(9, 8, {90})] and seen.get == {"read": 2, "dropped": 1}
    with pytest.raises(Exception, match="below the folder"):
        photos.write_photos(spark.createDataFrame([("../x", b"x")], "path string, content binary"), folder)
    assert not [d for d in os.listdir(folder) if d.startswith("_")] and len(names()) == 2


def test_a_retried_task_leaves_no_double(tmp_path, monkeypatch):
    writer = media.MediaWriter(str(tmp_path), False)
    batch = pa.RecordBatch.from_pydict({"path": pa.array(["x/a.jpg"]), "content": pa.array([b"1"], pa.binary())})

    def attempt(task, number, fails=False):
        monkeypatch.setattr(media.TaskContext, "get", lambda: types.SimpleNamespace(partitionId=lambda: task, taskAttemptId=lambda: number))

        def batches():
            yield batch
            if fails:
                raise OSError("lost")

        return writer.write(batches())

    with pytest.raises(OSError, match="lost"):
        attempt(0, 1, fails=True)
    attempt(0, 2)  # beside the one that counts
    writer.commit([attempt(0, 3), attempt(1, 4), None])
    files = sorted(os.path.relpath(os.path.join(d, f), tmp_path) for d, _, fs in os.walk(tmp_path) for f in fs)
    assert files == [f"part-0000{i}-{writer.job}/x/a.jpg" for i in (0, 1)]


def test_dated(spark):
    data = jpeg.encode(smooth(8, 8))
    df = spark.createDataFrame([(1, data, "2024:01:02 03:04:05"), (2, data, None), (3, b"no", "x"), (4, None, "x")], "id int, content binary, t string")
    got = {r.id: r.content for r in photos.dated(df, "t").collect()}
    assert photos.tags(photos.in_memory(bytes(got[1])))[1] == "2024:01:02 03:04:05"
    assert photos.tags(photos.in_memory(bytes(got[2])))[1] is None and got[3] is None and got[4] is None


class Counted:
    def __init__(self, data):
        self.data, self.read = data, 0

    def __call__(self, at, n):
        self.read += min(n, max(0, len(self.data) - at))
        return self.data[at : at + n]


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_frame_tables(n):
    frames = [bytes([65 + i % 26]) * (50 + i * 13) for i in range(n)]
    for data, rate in ((avi(frames, 30000, 1001), 30000 / 1001), (mp4(frames, 600, 20, 3), 30.0), (mp4(frames, 90000, 3003, 100), 90000 / 3003)):
        fps, offset, size, alone = videos.frame_table(photos.in_memory(data), len(data))
        assert fps == pytest.approx(rate) and alone.all()
        assert [data[a : a + s] for a, s in zip(offset, size, strict=True)] == frames


def test_frame_tables_of_other_files():
    data = avi([b"x" * 20] * 3, 10, 1)
    for bad in (b"", b"RIFF", data[:60], b"\0" * 100, mp4([b"a"], 1, 1, 1)[:-30], b"GIF89a" * 9, data.replace(b"vids", b"txts")):
        with pytest.raises(videos.Unreadable):
            videos.frame_table(photos.in_memory(bad), len(bad))
    empty = videos.avi_frames(photos.in_memory(avi([], 10, 1)))
    assert len(empty[1]) == 0


def test_only_tables_and_samples_are_read(spark, tmp_path):
    frames = [bytes([i]) * 100_000 for i in range(100)]
    (tmp_path / "a.avi").write_bytes(avi(frames, 10, 1))
    (tmp_path / "b.mp4").write_bytes(mp4(frames, 10, 1, 4))
    (tmp_path / "c.mp4").write_bytes(b"nothing")
    table = videos.frames(spark, str(tmp_path))
    assert table.groupBy("path").count().count() == 2 and table.agg(F.max("bytes_read")).first()[0] < 65536
    found = videos.with_bytes(videos.sampled(table)).collect()
    assert sorted((r.frame, r.sample, r.ms) for r in found) == sorted([(5 * i, i, 500.0 * i) for i in range(20)] * 2)
    assert all(bytes(r.content) == frames[r.frame] for r in found)
