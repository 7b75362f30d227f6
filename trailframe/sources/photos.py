"""Photos: the tags of JPEG headers, their pixels, and files of them."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trailframe.functions import exif
from trailframe.sources import jpeg, media
from trailframe.sources.files import IMAGES

#: Tags of the header's two directories.
DESCRIPTION, CHANGED, DETAILS, ORIGINAL = 270, 306, 0x8769, 36867

#: Bytes at a place, fewer at the end.
Read = Callable[[int, int], bytes]


def in_memory(data: bytes) -> Read:
    return lambda at, n: data[at : at + n]


def _within(read: Read, at: int, size: int) -> Read:
    """A part of it, from its own 0 on."""
    return lambda a, n: read(at + a, max(0, min(n, size - a)))


def _entries(read: Read, order: str, at: int) -> dict[int, tuple[int, int, bytes]]:
    """Tag -> kind, count and the four bytes of its value, of the directory at `at`."""
    (n,) = struct.unpack(order + "H", read(at, 2))
    block = read(at + 2, 12 * n)
    out = {}
    for k in range(n):
        tag, kind, count, value = struct.unpack_from(order + "HHI4s", block, 12 * k)
        out[tag] = (kind, count, value)
    return out


def _text(read: Read, order: str, entry: tuple[int, int, bytes] | None) -> str | None:
    if entry is None or entry[0] != 2:
        return None
    _, count, value = entry
    raw = value[:count] if count <= 4 else read(struct.unpack(order + "I", value)[0], count)
    return raw.split(b"\0")[0].decode("utf-8", "replace")


def headers(read: Read) -> Iterator[tuple[int, int]]:
    """Start and size of the contents of every segment that may hold a header: segments are walked by their lengths, so what stands before
    a header is not read."""
    at = 2
    while len(head := read(at, 4)) == 4 and head[0] == 0xFF:
        marker, size = head[1], int.from_bytes(head[2:])
        if marker == 0xFF or marker == 1 or 0xD0 <= marker <= 0xD7:  # filling, or a marker without contents
            at += 1 if marker == 0xFF else 2
            continue
        if marker in (0xDA, 0xD9) or size < 2:
            return
        if marker == 0xE1 and read(at + 4, 6) == b"Exif\0\0":
            yield at + 4, size - 2
        at += 2 + size


def tags(read: Read) -> tuple[str | None, str | None, str | None, bool, bool]:
    """changed, original, description, whether there is a header, and whether it is a JPEG at all. A damaged header counts as none. Of a
    header only its directories and the three texts are read."""
    if read(0, 2) != b"\xff\xd8":
        return None, None, None, False, False
    for at, size in headers(read):
        block = _within(read, at + 6, size - 6)
        try:
            order = {b"II": "<", b"MM": ">"}[block(0, 2)]
            main = _entries(block, order, struct.unpack(order + "I", block(4, 4))[0])
            details = _entries(block, order, struct.unpack(order + "I", main[DETAILS][2])[0]) if DETAILS in main else {}
            return _text(block, order, main.get(CHANGED)), _text(block, order, details.get(ORIGINAL)), _text(block, order, main.get(DESCRIPTION)), True, True
        except (struct.error, KeyError):
            return None, None, None, False, True
    return None, None, None, False, True


def header(original: str | None = None, changed: str | None = None, description: str | None = None) -> bytes:
    """The segment of a header with these tags."""
    main = [(t, v.encode() + b"\0") for t, v in ((DESCRIPTION, description), (CHANGED, changed)) if v is not None]
    details = [(ORIGINAL, original.encode() + b"\0")] if original is not None else []
    details_at = 8 + 2 + 12 * (len(main) + bool(details)) + 4
    at = details_at + (2 + 12 * len(details) + 4 if details else 0)
    directories, texts = [], b""
    for entries, below in ((main, [struct.pack("<HHII", DETAILS, 4, 1, details_at)] if details else []), (details, [])):
        rows = []
        for tag, value in entries:
            place = value.ljust(4, b"\0") if len(value) <= 4 else struct.pack("<I", at + len(texts))
            texts += value if len(value) > 4 else b""
            rows.append(struct.pack("<HHI", tag, 2, len(value)) + place)
        directories.append(struct.pack("<H", len(rows + below)) + b"".join(rows + below) + b"\0\0\0\0")
    block = b"Exif\0\0II*\0" + struct.pack("<I", 8) + directories[0] + (directories[1] if details else b"") + texts
    if len(block) > 65533:
        raise ValueError("tags are too long for a header")
    return b"\xff\xe1" + struct.pack(">H", len(block) + 2) + block


def with_header(data: bytes, original: str | None = None, changed: str | None = None, description: str | None = None) -> bytes:
    """The JPEG with a header of these tags in place of those it has; the picture's bytes stay."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    kept, end = [], 2
    for at, size in headers(in_memory(data)):
        kept.append(data[end : at - 4])
        end = at + size
    return data[:2] + header(original, changed, description) + b"".join([*kept, data[end:]])


SCHEMA = "path string, changed string, original string, description string, has_header boolean, readable boolean"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
TYPES = [pa.string()] * 4 + [pa.bool_()] * 2


def photo_tags(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = IMAGES) -> DataFrame:
    """SCHEMA, length and bytes_read of every photo below the folder. Tasks list the folders. Photos are read by ranges: some blocks of 4 KB
    each, wherever the header stands. In stores that only Spark opens whole files are read."""
    try:
        return tags_of(media.listed(spark, folder, suffixes))
    except pa.ArrowInvalid:
        return _whole_files(spark, folder, suffixes)


def _whole_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...]) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    files = files.where(F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*suffixes))

    def run(batches):
        for batch in batches:
            rows = [tags(in_memory(x.as_py())) for x in batch.column("content")]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(TYPES[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("path"), *columns, batch.column("length"), batch.column("length")], [*NAMES, "length", "bytes_read"])

    return files.select("path", "length", "content").mapInArrow(run, SCHEMA + ", length long, bytes_read long")


PIXELS = "image_width int, image_height int, pixels binary"


def tags_of(files: DataFrame) -> DataFrame:
    """SCHEMA, length and bytes_read of the files of a listing (path, length), read by ranges: of new files only, say. Files are dealt evenly,
    as a listing follows folders. Files that can't be opened any more count as unreadable."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                read = None
                try:
                    system, inside, _ = media.located(path)
                    with system.open_input_file(inside) as file:
                        read = media.Ranged(file, length)
                        found = tags(read)
                except FileNotFoundError:
                    found = (None, None, None, False, False)
                rows.append((path, *found, length, read.bytes_read if read else 0))
            kinds = [*TYPES, pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [*NAMES, "length", "bytes_read"])

    return media.dealt(files.select("path", "length")).mapInArrow(run, SCHEMA + ", length long, bytes_read long")


def decoded(photos: DataFrame, content: str = "content", decode: Callable[[bytes], np.ndarray] = jpeg.decode) -> DataFrame:
    """The table with image_width, image_height and pixels (rows of red, green and blue bytes) of the JPEG in `content`, which is left out. All three
    are null where it is null, damaged, or not baseline. Small photos of one shape are transformed together, large ones one at a time; rows go on together, some MB of them.
    `decode` may be another decoder, from bytes to an array of height x width x 3; it says by a ValueError that a photo is damaged."""
    rest = [c for c in photos.columns if c != content]
    for c in ("image_width", "image_height", "pixels"):
        if c in rest:
            raise ValueError(f"the table has a column {c} already")

    def image(data: bytes | None):
        try:
            return None if data is None else decode(data)
        except ValueError:  # jpeg.Damaged is one
            return None

    def run(batches):
        for batch in batches:
            sizes = []

            def pixels(batch=batch, sizes=sizes):
                values = (data.as_py() for data in batch.column(content))
                for found in jpeg.decoded(values) if decode is jpeg.decode else map(image, values):
                    sizes.append((None, None) if found is None else (found.shape[1], found.shape[0]))
                    yield None if found is None else found.tobytes()

            for rows, made in media.pieces(batch, pixels()):
                width, height = zip(*sizes, strict=True)
                sizes.clear()
                yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in rest], pa.array(width, pa.int32()), pa.array(height, pa.int32()), pa.array(made, pa.binary())], [*rest, "image_width", "image_height", "pixels"])

    schema = StructType([f for f in photos.schema.fields if f.name != content] + StructType.fromDDL(PIXELS).fields)
    return photos.mapInArrow(run, schema)


def decodable(photos: DataFrame) -> tuple[DataFrame, Observation]:
    """Of `decoded` photos those that have pixels; how many were `read` and `dropped` is observed while they are."""
    seen = Observation()
    return photos.observe(seen, F.count("*").alias("read"), F.count_if(F.col("pixels").isNull()).alias("dropped")).where("pixels is not null"), seen


def write_photos(photos: DataFrame, folder: str, path: str = "path", content: str = "content", mode: str = "append") -> None:
    """A file for each row below the folder, by the commit of `media.MediaSink`."""
    media.registered(photos.sparkSession)
    photos.select(F.col(path).alias("path"), F.col(content).alias("content")).write.format("media_files").mode(mode).save(folder)


def dated(photos: DataFrame, original: str, content: str = "content") -> DataFrame:
    """The table with the text of `original` (null: none) as the time of each JPEG's header, in place of the tags it has. What isn't a JPEG
    becomes null."""
    at, when = photos.columns.index(content), photos.columns.index(original)

    def run(batches):
        for batch in batches:
            pairs = zip(batch.column(at), batch.column(when), strict=True)
            both = ((d.as_py(), t.as_py()) for d, t in pairs)
            for rows, new in media.pieces(batch, (None if d is None or d[:2] != b"\xff\xd8" else with_header(d, t) for d, t in both)):
                yield rows.set_column(at, content, pa.array(new, pa.binary()))

    return photos.mapInArrow(run, photos.schema)


def cached_tags(photos: DataFrame) -> DataFrame:
    """File_Path, Date_Time, Description of `photo_tags`, with the cache's sentinels."""
    found = exif.date_and_description(F.col("changed"), F.col("original"), F.col("description"), F.col("has_header"), F.col("readable"))
    return photos.select(F.col("path").alias("File_Path"), found["date_time"].alias("Date_Time"), found["description"].alias("Description"))


def complete(cache: DataFrame) -> DataFrame:
    """Rows of the cache that need not be read again: those with a date and a description."""
    return cache.where((F.col("Date_Time") != exif.NO_DATE) & (F.col("Description") != exif.NO_DESCRIPTION))


def readable(cache: DataFrame) -> DataFrame:
    return cache.where(F.col("Date_Time") != exif.NO_FILE)


def refreshed(cache: DataFrame, wanted: DataFrame, read) -> DataFrame:
    """The cache's complete rows of the wanted files, and what `read` (from File_Path to File_Path, Date_Time, Description) finds for the
    other files."""
    files = wanted.select("File_Path").distinct()
    known = complete(cache.join(files, "File_Path", "left_semi"))
    new = readable(read(files.join(known.select("File_Path"), "File_Path", "left_anti")))
    return known.select("File_Path", "Date_Time", "Description").unionByName(new.select("File_Path", "Date_Time", "Description"))
