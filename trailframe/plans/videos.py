"""Queries over video files, which tasks write from a table first, and over pictures. Importing this adds them to the catalog."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from trailframe.functions import geometry, times
from trailframe.operators import crops, effects, tensors
from trailframe.plans.catalog import _t, query
from trailframe.sources import files, jpeg, media, photos, videos
from trailframe.sources.shared import scratch, settled


def _chunk(name: bytes, *contents: bytes) -> bytes:
    data = b"".join(contents)
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)


def avi(frames: list[bytes], rate: int, scale: int) -> bytes:
    """An AVI of these frames and a sound stream's chunk after each, with an index. For fixtures."""
    sound = _chunk(b"LIST", b"strl", _chunk(b"strh", b"auds", bytes(52)))
    video = _chunk(b"LIST", b"strl", _chunk(b"strh", b"vidsMJPG" + bytes(12) + struct.pack("<II", scale, rate) + bytes(28)))
    head = _chunk(b"LIST", b"hdrl", _chunk(b"avih", bytes(56)), sound, video)
    body, index, at = [], [], 4
    for f in frames:
        for name, data in ((b"01dc", f), (b"00wb", b"sound")):
            piece = _chunk(name, data)
            index.append(struct.pack("<4sIII", name, 16, at, len(data)))
            body.append(piece)
            at += len(piece)
    return _chunk(b"RIFF", b"AVI ", head, _chunk(b"LIST", b"movi", *body), _chunk(b"idx1", *index))


def _box(name: bytes, *contents: bytes) -> bytes:
    data = b"".join(contents)
    return struct.pack(">I", len(data) + 8) + name + data


def mp4(frames: list[bytes], ticks: int, each: int, chunk: int) -> bytes:
    """An MP4 of these frames, `each` of `ticks` a second long, in chunks of `chunk` frames with other bytes between. For fixtures."""
    full = lambda name, *numbers: _box(name, bytes(4), b"".join(struct.pack(">I", n) for n in numbers))
    body, starts, at = [], [], 16 + 8
    for i in range(0, len(frames), chunk):
        body.append(b"sound" + b"".join(frames[i : i + chunk]))
        starts.append(at + 5)
        at += len(body[-1])
    rest = len(frames) % chunk
    runs = [1, chunk, 1] if len(frames) >= chunk else []
    runs += [len(starts), rest, 1] if rest else []
    stbl = _box(b"stbl", full(b"stts", 1, len(frames), each), full(b"stsz", 0, len(frames), *map(len, frames)), full(b"stsc", len(runs) // 3, *runs), full(b"stco", len(starts), *starts))
    track = lambda kind, *more: _box(b"trak", _box(b"mdia", full(b"mdhd", 0, 0, ticks, len(frames) * each, 0), _box(b"hdlr", bytes(8) + kind + bytes(12)), *more))
    return _box(b"ftyp", b"isom\0\0\0\0") + _box(b"mdat", *body) + _box(b"moov", full(b"mvhd", 0, 0, ticks, 0), track(b"soun"), track(b"vide", _box(b"minf", stbl)))


def _supplier_videos(spark, sf_dir):
    """path, content: a video of 1 to 150 frames for each supplier, of one colour, with its number as the comment of each frame; every
    thirteenth is cut."""
    rows = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), "s_nationkey")
    rows = rows.select(F.concat("s_nationkey", F.lit("/clip"), "k", F.when(F.col("k") % 2 == 0, ".AVI").otherwise(".mp4")).alias("path"), "k")
    rows = rows.repartition(media.tasks(spark), "k")  # files of a table may be few

    def video(k: int) -> bytes:
        data = jpeg.encode(np.full((8, 8, 3), [k * 7 % 254, k * 13 % 254, k * 29 % 254], np.uint8), 95)
        frames = [data[:2] + b"\xff\xfe" + struct.pack(">HI", 6, f) + data[2:] for f in range(1 + k * 7 % 150)]
        made = avi(frames, 10, 1) if k % 2 == 0 else mp4(frames, 600, 48, 1 + k % 4)
        return made[: len(made) // 2] if k % 13 == 0 else made

    def make(batches):
        for batch in batches:
            for rows, out in media.pieces(batch, map(video, batch.column("k").to_pylist())):
                yield pa.RecordBatch.from_arrays([rows.column("path"), pa.array(out, pa.binary())], ["path", "content"])

    return rows.mapInArrow(make, "path string, content binary")


@query("""WITH v AS (SELECT s_suppkey AS k, concat(s_nationkey, '/clip', s_suppkey) AS stem, 1 + s_suppkey * 7 % 150 AS n, CASE WHEN s_suppkey % 2 = 0 THEN 10.0 ELSE 12.5 END AS fps FROM supplier WHERE s_suppkey % 13 <> 0),
s AS (SELECT *, CAST(floor(fps * 0.5) AS BIGINT) AS plain, greatest(CASE WHEN n < CAST(floor(fps * 0.5) AS BIGINT) THEN n - 1 ELSE CAST(floor(fps * 0.5) AS BIGINT) END, 1) AS fit FROM v),
t AS (SELECT *, CASE WHEN n // fit > 20 THEN n // 20 ELSE fit END AS step FROM s),
f AS (SELECT *, unnest(range(0, n, step)) AS frame FROM t)
SELECT stem || '_' || lpad(CAST(frame // step AS VARCHAR), 4, '0') || '.jpg' AS path, CAST(frame AS BIGINT) AS frame, frame / fps * 1000 AS ms, true AS near,
strftime(TIMESTAMP '2024-03-01' + to_seconds(k) + to_microseconds(CAST(floor(frame / fps * 1000000) AS BIGINT)), '%Y:%m:%d %H:%M:%S') AS date_time FROM f""")
def video_frames(spark, sf_dir):
    """Videos of all suppliers are written; of the sampled frames the bytes are read, dated by their place in the video, and written as
    photos, whose headers and pixels are read again."""
    with scratch(spark) as folder:
        photos.write_photos(_supplier_videos(spark, sf_dir), f"{folder}/videos")
        found = videos.with_bytes(videos.sampled(videos.frames(spark, f"{folder}/videos")))
        number = F.regexp_extract("path", r"clip(\d+)\.", 1).cast("long")
        start = F.lit("2024-03-01").cast("timestamp") + F.make_interval(secs=number)
        name = F.concat(F.regexp_extract("path", r"/part-[^/]*/(.*)\.[^.]*$", 1), F.lit("_"), F.lpad(F.col("sample").cast("string"), 4, "0"), F.lit(".jpg"))
        found = found.select("frame", "ms", number.alias("k"), name.alias("path"), F.date_format(times.add_milliseconds(start, F.col("ms")), times.CAMERA).alias("original"), "content")
        found = settled(photos.dated(found, "original"))
        photos.write_photos(found, f"{folder}/photos")
        relative = F.regexp_extract("path", "/part-[^/]*/(.*)$", 1)
        tags = photos.photo_tags(spark, f"{folder}/photos").select(relative.alias("path"), F.col("original").alias("date_time"))

        def compare(batches):
            for batch in batches:
                near = []
                for k, f, data in zip(*[batch.column(c).to_pylist() for c in ("k", "frame", "content")], strict=True):
                    comment = data.find(b"\xff\xfe\0\6")
                    own = int.from_bytes(data[comment + 4 : comment + 8]) == f
                    near.append(bool(own and np.abs(jpeg.decode(data).astype(int) - [k * 7 % 254, k * 13 % 254, k * 29 % 254]).max() <= 2))
                yield pa.RecordBatch.from_arrays([*batch.select(["path", "frame", "ms"]).columns, pa.array(near)], ["path", "frame", "ms", "near"])

        return settled(found.select("k", "frame", "content", "path", "ms").mapInArrow(compare, "path string, frame long, ms double, near boolean").join(tags, "path"))


def _draw(name: str, low: float = 0, high: float = 1) -> str:
    n = f"(CAST(('0x' || substr(md5('{name}:' || md5(concat_ws('|', k, '0'))), 1, 12)) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE"
    return f"({low}::DOUBLE + {n} * ({high}::DOUBLE - {low}::DOUBLE))"


@query(f"""SELECT k AS c_custkey, {_draw('moved')} < 0.8 AS moved, round({_draw('dx', -0.1, 0.1)}, 9) + 0 AS dx, round(1 + {_draw('scale', -0.75, 0.1)}, 9) AS scale, round({_draw('degrees', -30, 30)}, 9) + 0 AS degrees,
CASE WHEN {_draw('colour')} < 0.5 THEN CAST(floor({_draw('kind', 1, 4)}) AS INTEGER) ELSE 0 END AS colour, {_draw('grey')} < 0.2 AS grey, {_draw('flipped')} < 0.5 AS flipped,
CASE WHEN {_draw('compressed')} < 0.2 THEN CAST(floor({_draw('quality', 70, 101)}) AS INTEGER) ELSE 0 END AS quality FROM (SELECT c_custkey AS k FROM customer)""")
def picture_draws(spark, sf_dir):
    """What is drawn for the picture of each customer."""
    rows = _t(spark, sf_dir, "customer").select("c_custkey", tensors.draws("c_custkey").alias("d"))
    numbers = [(F.round(f"d.{c}", 9) + 0).alias(c) for c in ("dx", "scale", "degrees")]
    return rows.select("c_custkey", "d.moved", *numbers, "d.colour", "d.grey", "d.flipped", "d.quality")


@query("""WITH p AS (SELECT c_custkey AS k, 12 + c_custkey % 5 AS w, 13 + c_custkey % 3 AS h, c_custkey * 7 % 254 + 1 AS v FROM customer),
m AS (SELECT *, CAST(floor(0.25 * least(w - 1, h - 1)) AS BIGINT) AS m FROM p),
c AS (SELECT k, floor(v * (least(1, least(y, h - 2 - y) / (m - 1)::DOUBLE) * least(1, least(x, w - 2 - x) / (m - 1)::DOUBLE))) AS red FROM m, range(0, 20) a(x), range(0, 20) b(y) WHERE x < w - 1 AND y < h - 1)
SELECT p.k AS c_custkey, CAST(w AS INTEGER) AS image_width, CAST(h AS INTEGER) AS image_height, CAST(sum(red) AS BIGINT) AS total, round((any_value(v) / 255.0 - 0.485) / 0.229, 4) AS middle FROM p JOIN c USING (k) GROUP BY p.k, w, h""")
def faded_pictures(spark, sf_dir):
    """A picture of one colour for each customer, faded to its edges, and the middle of its tensor before that."""
    rows = _t(spark, sf_dir, "customer").select("c_custkey", (12 + F.col("c_custkey") % 5).cast("int").alias("image_width"), (13 + F.col("c_custkey") % 3).cast("int").alias("image_height"))
    rows = rows.repartition(media.tasks(spark), "c_custkey")  # files of a table may be few

    def make(batches):
        for batch in batches:
            k, w, h = (batch.column(i).to_pylist() for i in range(3))
            out = [bytes([n * 7 % 254 + 1, 1, 200]) * (a * b) for n, a, b in zip(k, w, h, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], ["c_custkey", "image_width", "image_height", "pixels"])

    def red(batches):
        for batch in batches:
            total = [int(np.frombuffer(p, np.uint8)[::3].sum()) for p in batch.column("pixels").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.select(["c_custkey", "image_width", "image_height"]).columns, pa.array(total)], ["c_custkey", "image_width", "image_height", "total"])

    made = rows.mapInArrow(make, "c_custkey long, image_width int, image_height int, pixels binary")
    sums = tensors.faded(made, "c_custkey", 0.25, 0.25).mapInArrow(red, "c_custkey long, image_width int, image_height int, total long")
    middle = tensors.tensors(tensors.centred(made, 8)).select("c_custkey", F.round(F.get("tensor", F.lit(36)).cast("double"), 4).alias("middle"))
    return sums.join(middle, "c_custkey")


@query(f"""SELECT k AS c_custkey, CASE WHEN {_draw('weather')} < 0.2 THEN CASE WHEN {_draw('sort')} < 0.5 THEN 1 ELSE 2 END ELSE 0 END AS weather, {_draw('warped')} < 0.1 AS warped,
round({_draw('column4', 0.9, 1.1)}, 9) AS column4, round({_draw('hue', -40, 40)}, 9) + 0 AS hue, CASE WHEN {_draw('shadow')} < 0.2 THEN round({_draw('shadow_y4', 0.5, 1)}, 9) END AS shadow_y4,
CASE WHEN {_draw('flare')} < 0.2 THEN round({_draw('flare_turn', 0, 360)}, 9) END AS flare_turn, CASE WHEN {_draw('blurred')} < 0.1 THEN round({_draw('blur', 0, 9)}, 9) ELSE 0 END AS blur,
CAST(2 * floor({_draw('blur_size', 1, 4)}) + 1 AS INTEGER) AS blur_size FROM (SELECT c_custkey AS k FROM customer)""")
def effect_draws(spark, sf_dir):
    """What weather, light and lenses are drawn for the picture of each customer."""
    d = _t(spark, sf_dir, "customer").select("c_custkey", tensors.draws("c_custkey").alias("d"))
    last = {"column4": F.get("d.columns", F.lit(4)), "hue": F.col("d.hue"), "shadow_y4": F.get("d.shadow", F.lit(9)), "flare_turn": F.get("d.flare", F.lit(2)), "blur": F.col("d.blur")}
    numbers = [(F.round(v, 9) + 0).alias(k) for k, v in last.items()]
    return d.select("c_custkey", "d.weather", "d.warped", *numbers, "d.blur_size")


@query("""WITH p AS (SELECT c_custkey AS k, 12 + c_custkey % 5 AS w, 10 + c_custkey % 3 AS h, 1 + c_custkey % 3 AS s FROM customer),
c AS (SELECT k, w, h, s, x, y, (x * 37 + y * 23 + k * 11) % 200 AS v FROM p, range(0, 16) a(x), range(0, 12) b(y) WHERE x < w AND y < h),
d AS (SELECT *, CASE WHEN (x + 0.5::DOUBLE) / w < 0.37 AND (y + 0.5::DOUBLE) / h >= 0.53 THEN CAST(round_even(v * 0.5::DOUBLE, 0) AS BIGINT) ELSE v END AS dark FROM c),
g AS (SELECT k, x, y, s, w, h, dark, exp(-1 / (2::DOUBLE * s * s)) AS e FROM d),
n AS (SELECT a.k, a.x, a.y, (a.dark + a.e * (coalesce(u.dark, o.dark) + coalesce(o.dark, u.dark))) / (1 + 2 * a.e) AS v, a.e, a.w FROM g a LEFT JOIN g u ON u.k = a.k AND u.x = a.x AND u.y = a.y - 1 LEFT JOIN g o ON o.k = a.k AND o.x = a.x AND o.y = a.y + 1),
m AS (SELECT a.k, round((a.v + a.e * (coalesce(l.v, r.v) + coalesce(r.v, l.v))) / (1 + 2 * a.e), 9) AS v FROM n a LEFT JOIN n l ON l.k = a.k AND l.y = a.y AND l.x = a.x - 1 LEFT JOIN n r ON r.k = a.k AND r.y = a.y AND r.x = a.x + 1)
SELECT k AS c_custkey, CAST(total AS BIGINT) AS shaded, CAST(blurred AS BIGINT) AS blurred FROM (SELECT k, sum(round_even(v, 0)) AS blurred FROM m GROUP BY k) JOIN (SELECT k, sum(dark) AS total FROM d GROUP BY k) USING (k)""")
def shaded_and_blurred(spark, sf_dir):
    """A picture for each customer whose lower left lies in a shadow: the sum of its red, as it is and blurred over three pixels."""
    rows = _t(spark, sf_dir, "customer").select("c_custkey", (12 + F.col("c_custkey") % 5).cast("int").alias("image_width"), (10 + F.col("c_custkey") % 3).cast("int").alias("image_height"))
    rows = rows.repartition(media.tasks(spark), "c_custkey")  # files of a table may be few

    def make(batches):
        for batch in batches:
            k, w, h = (batch.column(i).to_pylist() for i in range(3))
            out = [np.repeat((np.arange(a) * 37 + np.arange(b)[:, None] * 23 + n * 11) % 200, 3).astype(np.uint8).tobytes() for n, a, b in zip(k, w, h, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], ["c_custkey", "image_width", "image_height", "pixels"])

    def red(name):
        def run(batches):
            for batch in batches:
                total = [int(np.frombuffer(p, np.uint8)[::3].sum()) for p in batch.column("pixels").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("c_custkey"), pa.array(total)], ["c_custkey", name])

        return run

    made = rows.mapInArrow(make, "c_custkey long, image_width int, image_height int, pixels binary")
    dark = tensors.changed(made, lambda image: effects.shaded(image, [0, 0.53, 0.37, 0.53, 0.37, 1.01, 0, 1.01]))
    soft = tensors.changed(dark.withColumn("s", (1 + F.col("c_custkey") % 3).cast("double")), lambda image, s: effects.blurred(image, s, 3), "s")
    return dark.mapInArrow(red("shaded"), "c_custkey long, shaded long").join(soft.mapInArrow(red("blurred"), "c_custkey long, blurred long"), "c_custkey")


@query("""WITH b AS (SELECT c_custkey AS k, CAST(c_custkey % 7 AS DOUBLE) / 10 AS x, CAST(c_custkey % 5 AS DOUBLE) / 10 AS y, 0.1 + CAST(c_custkey % 9 AS DOUBLE) / 20 AS w, 0.15 + CAST(c_custkey % 4 AS DOUBLE) / 10 AS h FROM customer),
l AS (SELECT *, greatest((least(x + w + 0.05, 1) - greatest(x - 0.05, 0)) * 60, (least(y + h + 0.05, 1) - greatest(y - 0.05, 0)) * 44) AS longest FROM b),
s AS (SELECT *, CASE WHEN longest > 24 THEN 24 / longest END AS scale FROM l),
d AS (SELECT *, CASE WHEN scale IS NULL THEN 60 ELSE round_even(60 * scale, 0) END AS iw, CASE WHEN scale IS NULL THEN 44 ELSE round_even(44 * scale, 0) END AS ih FROM s),
f AS (SELECT *, trunc((x + w / 2) * iw - 12) AS fx, trunc((y + h / 2) * ih - 12) AS fy FROM d),
e AS (SELECT *, CASE WHEN fx < 0 AND fx + 24 > iw THEN 0 ELSE greatest(fx - least(fx, 0) - greatest(fx + 24 - iw, 0), 0) END AS wl, CASE WHEN fy < 0 AND fy + 24 > ih THEN 0 ELSE greatest(fy - least(fy, 0) - greatest(fy + 24 - ih, 0), 0) END AS wt,
  CASE WHEN fx < 0 AND fx + 24 > iw THEN iw ELSE least(fx - least(fx, 0) - greatest(fx + 24 - iw, 0) + 24, iw) END AS wr, CASE WHEN fy < 0 AND fy + 24 > ih THEN ih ELSE least(fy - least(fy, 0) - greatest(fy + 24 - ih, 0) + 24, ih) END AS wb,
  0.1 * least(w, h) AS m FROM f),
r AS (SELECT *, floor(greatest(x - m, 0) * 60) AS rl, floor(greatest(y - m, 0) * 44) AS rt, floor(least(x + w + m, 1) * 60) AS rr, floor(least(y + h + m, 1) * 44) AS rb FROM e)
SELECT k || '.jpg' AS path, 24 AS image_width, 24 AS image_height, '[' || array_to_string([round_even(wl / iw, 4), round_even(wt / ih, 4), round_even(wr / iw, 4), round_even(wb / ih, 4)], ', ') || ']' AS crop,
CAST(CASE WHEN scale IS NULL THEN greatest(least(wr, rr) - greatest(wl, rl), 0) * greatest(least(wb, rb) - greatest(wt, rt), 0) END AS BIGINT) AS bright FROM r""")
def photo_crops(spark, sf_dir):
    """Photos of all customers are written, read, cut out around a box and written again; `bright` counts the pixels of those crops that
    aren't black, where the photo was not scaled."""
    k = F.col("c_custkey")
    boxes = {"x_min": (k % 7).cast("double") / 10, "y_min": (k % 5).cast("double") / 10, "Width": 0.1 + (k % 9).cast("double") / 20, "Height": 0.15 + (k % 4).cast("double") / 10}
    rows = _t(spark, sf_dir, "customer").select(F.concat(k.cast("string"), F.lit(".jpg")).alias("name"), *[v.alias(c) for c, v in boxes.items()])
    rows = rows.repartition(media.tasks(spark), "name")  # files of a table may be few

    def make(batches):
        data = jpeg.encode(np.full((44, 60, 3), 220, np.uint8))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array([data] * batch.num_rows, pa.binary())], ["path", "content"])

    def count(batches):
        for batch in batches:
            bright = [int((np.frombuffer(p, np.uint8)[::3] > 110).sum()) for p in batch.column("pixels").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, pa.array(bright)], [*kept, "bright"])

    def pictures(folder, beside):
        return photos.decoded(files.contents(spark, folder, beside=beside).drop("path", "modificationTime", "length"))

    kept = ["name", "image_width", "image_height", "crop", "plain"]
    with scratch(spark) as folder:
        photos.write_photos(rows.select("name").mapInArrow(make, "path string, content binary"), f"{folder}/photos")
        cut = settled(crops.encoded(crops.cropped(pictures(f"{folder}/photos", rows), 24, 0.1, 0.05)))
        photos.write_photos(cut, f"{folder}/crops", path="name")
        plain = geometry.new_scale(*[F.col(c) for c in boxes], F.lit(60), F.lit(44), 0.05, 24).isNull()
        cut = cut.select("name", plain.alias("plain"), F.concat(F.lit("["), F.array_join(F.transform("Crop", lambda v: v.cast("string")), ", "), F.lit("]")).alias("crop"))
        found = pictures(f"{folder}/crops", cut).mapInArrow(count, "name string, image_width int, image_height int, crop string, plain boolean, bright long")
        return settled(found.select(F.col("name").alias("path"), "image_width", "image_height", "crop", F.when(F.col("plain"), F.col("bright")).alias("bright")))
