"""Frames of video files: where they lie, from the containers' own tables, and their bytes. Frames that aren't sampled are not read."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource
from pyspark.sql.types import BinaryType, StructField, StructType

from trailframe.functions import schedules
from trailframe.sources import media

Read = Callable[[int, int], bytes]
#: Frames a second, and of each frame where it lies, how many bytes it has, and whether it stands alone.
Table = tuple[float, np.ndarray, np.ndarray, np.ndarray]


class Unreadable(ValueError):
    """No such container, or none with a video."""


def _chunks(read: Read, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Name, start and end of the contents of each RIFF chunk."""
    while at + 8 <= end and len(head := read(at, 8)) == 8:
        name, size = struct.unpack("<4sI", head)
        yield name, at + 8, min(at + 8 + size, end)
        at += 8 + size + size % 2


def avi_frames(read: Read) -> Table:
    """The first video stream's frames by the index at the end of the file. Offsets in it count from the list of frames, or from the start
    of the file. Frames of no bytes (the one before is shown again) are left out."""
    head = read(0, 12)
    if head[:4] != b"RIFF" or head[8:] != b"AVI ":
        raise Unreadable("no AVI")
    end = 8 + int.from_bytes(head[4:8], "little")
    rate, stream, movi, index, streams = 0.0, None, None, b"", 0
    for name, a, b in _chunks(read, 12, end):
        kind = read(a, 4) if name == b"LIST" else b""
        if kind == b"hdrl":
            for inner, c, d in _chunks(read, a + 4, b):
                if inner == b"LIST" and read(c, 4) == b"strl":
                    for part, e, f in _chunks(read, c + 4, d):
                        if part == b"strh" and stream is None and read(e, 4) == b"vids":
                            scale, ticks = struct.unpack("<II", read(e + 20, 8))
                            rate, stream = ticks / scale, streams
                    streams += 1
        elif kind == b"movi":
            movi = a
        elif name == b"idx1":
            index = read(a, b - a)
    if stream is None or movi is None or not rate:
        raise Unreadable("no video in it")
    rows = np.frombuffer(index[: len(index) // 16 * 16], np.dtype([("name", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]))
    own = np.isin(rows["name"], [b"%02ddc" % stream, b"%02ddb" % stream])
    rows = rows[own & (rows["size"] > 0)]
    at = rows["at"].astype(np.int64)
    base = movi if len(at) and read(movi + int(at[0]), 4) == rows["name"][0] else 0
    return rate, at + base + 8, rows["size"].astype(np.int64), rows["flags"] & 16 > 0


def _boxes(read: Read, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Name, start and end of the contents of each box."""
    while at + 8 <= end and len(head := read(at, 8)) == 8:
        size, name = struct.unpack(">I4s", head)
        skip = 8
        if size == 1:
            size, skip = int.from_bytes(read(at + 8, 8)), 16
        size = size or end - at
        if size < skip:
            raise Unreadable("damaged")
        yield name, at + skip, min(at + size, end)
        at += size


def _inside(read: Read, a: int, b: int, *names: bytes) -> tuple[int, int] | None:
    for name in names:
        found = next(((c, d) for n, c, d in _boxes(read, a, b) if n == name), None)
        if found is None:
            return None
        a, b = found
    return a, b


def mp4_frames(read: Read, length: int) -> Table:
    """The first video track's frames by its tables of times, sizes, chunks and key frames. The rate is frames by duration."""
    movie = _inside(read, 0, length, b"moov")
    if movie is None:
        raise Unreadable("no MP4")
    for name, a, b in _boxes(read, *movie):
        kind = _inside(read, a, b, b"mdia", b"hdlr") if name == b"trak" else None
        if kind is not None and read(kind[0] + 8, 4) == b"vide":
            break
    else:
        raise Unreadable("no video in it")

    def numbers(name: bytes, skip: int = 8, kind: str = ">u4") -> np.ndarray | None:
        box = _inside(read, a, b, b"mdia", b"minf", b"stbl", name)
        if box is None:
            return None
        data = read(box[0] + skip, box[1] - box[0] - skip)
        return np.frombuffer(data[: len(data) // np.dtype(kind).itemsize * np.dtype(kind).itemsize], kind).astype(np.int64)

    clock = _inside(read, a, b, b"mdia", b"mdhd")
    times, sizes, runs = numbers(b"stts"), numbers(b"stsz", 4), numbers(b"stsc")
    starts = numbers(b"stco")
    starts = numbers(b"co64", kind=">u8") if starts is None else starts
    if clock is None or times is None or sizes is None or runs is None or starts is None:
        raise Unreadable("a table is missing")
    ticks = int.from_bytes(read(clock[0] + (20 if read(clock[0], 1) == b"\1" else 12), 4))
    size = np.full(sizes[1], sizes[0]) if sizes[0] else sizes[2 : 2 + sizes[1]]
    times = times.reshape(-1, 2)
    spent = int((times[:, 0] * times[:, 1]).sum())
    if not len(size) or not spent or not ticks:
        raise Unreadable("no frames")
    runs = runs.reshape(-1, 3)  # first chunk (from 1), frames a chunk
    each = np.repeat(runs[:, 1], np.diff(np.r_[runs[:, 0], len(starts) + 1]))
    chunk = np.repeat(np.arange(len(starts)), each)[: len(size)]
    size = size[: len(chunk)]
    before = np.cumsum(size) - size
    first = np.r_[True, chunk[1:] != chunk[:-1]]
    offset = starts[chunk] + before - np.maximum.accumulate(np.where(first, before, 0))
    keys = numbers(b"stss")
    alone = np.ones(len(size), bool) if keys is None else np.isin(np.arange(1, len(size) + 1), keys)
    return len(size) * ticks / spent, offset, size, alone


def frame_table(read: Read, length: int) -> Table:
    try:
        return avi_frames(read) if read(0, 4) == b"RIFF" else mp4_frames(read, length)
    except (struct.error, ValueError, IndexError, ZeroDivisionError) as error:
        raise Unreadable(str(error)) from error


SCHEMA = "path string, fps double, total long, frame long, offset long, size long, alone boolean, bytes_read long"


class FrameSource(DataSource):
    """`video_frames`: a row for each frame of the AVI and MP4 files below `path`, from their tables. Files that can't be read have none."""

    @classmethod
    def name(cls) -> str:
        return "video_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FrameReader:
        return FrameReader(self.options, ".avi,.mp4,.mov")


def _rows(path: str, read: media.Ranged) -> Iterator[pa.RecordBatch]:
    """The rows of a file, none if it can't be read."""
    try:
        fps, offset, size, alone = frame_table(read, read.length)
    except Unreadable:
        return
    n = len(offset)
    columns = [pa.array([path] * n, pa.string()), pa.array(np.full(n, fps)), pa.array(np.full(n, n)), pa.array(np.arange(n)), pa.array(offset), pa.array(size.astype(np.int64)), pa.array(alone), pa.array(np.full(n, read.bytes_read))]
    yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCHEMA.split(", ")])


class FrameReader(media.FileReader):
    def read(self, partition: media.Files) -> Iterator[pa.RecordBatch]:
        for path, read in self.opened(partition):
            yield from _rows(path, read)


SUFFIXES = (".avi", ".mp4", ".mov")


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """SCHEMA of the files below the folder, which tasks list."""

    def run(batches):
        for batch in batches:
            for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                system, inside, _ = media.located(path)
                with system.open_input_file(inside) as file:
                    yield from _rows(path, media.Ranged(file, length))

    return media.dealt(media.listed(spark, folder, SUFFIXES).select("path", "length")).mapInArrow(run, SCHEMA)


def sampled(table: DataFrame, seconds: float = 0.5, most: int = 20) -> DataFrame:
    """The frames of the schedule, with `sample` (from 0) and `ms` from the start."""
    step = schedules.frame_step(F.col("total"), F.col("fps"), seconds, most)
    rows = table.withColumn("__step", step).where(F.col("frame") % F.col("__step") == 0)
    return rows.withColumns({"sample": F.floor(F.col("frame") / F.col("__step")), "ms": schedules.frame_offset_ms(F.col("frame"), F.col("fps"))}).drop("__step")


def with_bytes(table: DataFrame, content: str = "content") -> DataFrame:
    """The table (path, offset, size) with the bytes there. A file is opened once for rows that follow each other; only those bytes are read."""
    at = [table.columns.index(c) for c in ("path", "offset", "size")]

    def run(batches):
        name, file = None, None

        def read(batch):
            nonlocal name, file
            for path, offset, size in zip(*[batch.column(i).to_pylist() for i in at], strict=True):
                if path != name:
                    if file is not None:
                        file.close()
                    system, inside, _ = media.located(path)
                    name, file = path, system.open_input_file(inside)
                yield file.read_at(size, offset)

        for batch in batches:
            for rows, data in media.pieces(batch, read(batch)):
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(data, pa.binary())], [*rows.schema.names, content])
        if file is not None:
            file.close()

    return table.mapInArrow(run, StructType([*table.schema.fields, StructField(content, BinaryType())]))
