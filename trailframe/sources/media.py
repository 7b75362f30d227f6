"""Spark data sources for media files: headers of photos read by ranges of bytes, and files written from rows under a commit."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import BinaryType, StructField, StructType

from trailframe.sources.shared import settled

#: Bytes that are read at once, and what opening a file and reading its header count for when files are dealt to tasks.
BLOCK, OPENING, TOUCHED = 4096, 1 << 18, 1 << 16
#: Bytes of values that a task gathers before it hands them on, and rows of a listing.
HELD, ROWS = 8 << 20, 10_000


def located(path: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a path or URI, the path in it, and what stands before its paths in Spark's listings. Raises pyarrow.ArrowInvalid
    for stores that only Spark reads."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), os.path.abspath(path), "file:"
    system, inside = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return system, inside, path[: len(path) - len(inside)] if path.endswith(inside) else path.split("://")[0] + "://"


def pieces(batch: pa.RecordBatch, made: Iterable[bytes | None]) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Rows of the batch beside the values made for them, in order, cut as soon as the values have HELD bytes."""
    start, held, size = 0, [], 0
    for value in made:
        held.append(value)
        size += len(value or b"")
        if size >= HELD:
            yield batch.slice(start, len(held)), held
            start, held, size = start + len(held), [], 0
    if held:
        yield batch.slice(start, len(held)), held


def tasks(spark: SparkSession) -> int:
    """Parts that rows are dealt over before long work on each."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _hidden(name: str) -> bool:
    """As Spark's listings have it."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def entries(path: str) -> Iterator[tuple[str, int | None, int | None]]:
    """Path, length (null: a folder) and milliseconds of the last change of what lies in a folder, or of the file that it is."""
    system, inside, prefix = located(path)
    if not isinstance(system, fs.LocalFileSystem):
        own = system.get_file_info(inside)
        for f in [own] if own.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inside)):
            if f.type == fs.FileType.Directory:
                yield prefix + f.path, None, None
            elif f.type == fs.FileType.File:
                yield prefix + f.path, f.size, (f.mtime_ns or 0) // 1_000_000
        return
    if not os.path.isdir(inside):
        found = os.stat(inside)
        yield prefix + inside, found.st_size, found.st_mtime_ns // 1_000_000
        return
    with os.scandir(inside) as found_here:
        for e in found_here:
            if e.is_dir():
                yield prefix + e.path, None, None
                continue
            try:
                found = e.stat()
            except FileNotFoundError:  # gone meanwhile
                continue
            yield prefix + e.path, found.st_size, found.st_mtime_ns // 1_000_000


def _listed(deep: bool):
    """The entries of each folder, hidden ones aside; `deep`: of those in it as well."""

    def walk(path: str) -> Iterator[tuple[str, int | None, int | None]]:
        for entry in entries(path):
            if _hidden(entry[0].rstrip("/").rsplit("/", 1)[-1]):
                continue
            if deep and entry[1] is None:
                yield from walk(entry[0])
            else:
                yield entry

    def run(batches):
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                found = walk(folder)
                while rows := list(islice(found, ROWS)):
                    columns = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "length", "changed"])

    return run


def listed(spark: SparkSession, folder: str, suffixes: tuple[str, ...]) -> DataFrame:
    """path, modificationTime, length of the files below the folder with one of these suffixes, in any case. Tasks list folders, a level of
    them after the other until there is one for each task, then all below; the driver holds no name. A folder's own entries are listed by one
    task. Raises pyarrow.ArrowInvalid for stores that only Spark reads."""
    located(folder)
    schema, n = "path string, length long, changed long", tasks(spark)
    folders, levels, many, deep = spark.createDataFrame([(folder,)], "path string").coalesce(1), [], 1, False
    while many:
        deep = many >= n
        level = settled(folders.mapInArrow(_listed(deep), schema))
        levels.append(level.where("length IS NOT NULL"))
        folders = level.where("length IS NULL").select("path")
        many = 0 if deep else folders.count()
        folders = folders.repartition(n, "path")
    files = reduce(DataFrame.union, levels)
    files = files.where(F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*suffixes))
    return files.select("path", F.timestamp_millis("changed").alias("modificationTime"), "length")


def dealt(files: DataFrame) -> DataFrame:
    """The listing dealt evenly over tasks, as it follows folders."""
    return files.repartition(tasks(files.sparkSession), "path")


def with_contents(files: DataFrame, content: str = "content") -> DataFrame:
    """The rows of a listing with the bytes of each file. They are dealt over tasks, which hold HELD bytes and the last file at once."""
    at = files.columns.index("path")

    def run(batches):
        for batch in batches:

            def read():
                for path in batch.column(at).to_pylist():
                    system, inside, _ = located(path)
                    with system.open_input_file(inside) as file:
                        yield file.read()

            for rows, data in pieces(batch, read()):
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(data, pa.binary())], [*rows.schema.names, content])

    return dealt(files).mapInArrow(run, StructType([*files.schema.fields, StructField(content, BinaryType())]))


class Ranged:
    """A file of which only the blocks that are asked for are read."""

    def __init__(self, file: pa.NativeFile, length: int):
        self.file, self.length, self.blocks, self.bytes_read = file, length, {}, 0

    def __call__(self, at: int, n: int) -> bytes:
        """The n bytes at `at`, fewer at the end of the file."""
        end = min(at + n, self.length)
        wanted = range(at // BLOCK, -(-end // BLOCK))
        missing = [i for i in wanted if i not in self.blocks]
        if missing:
            first = missing[0] * BLOCK
            data = self.file.read_at(min((missing[-1] + 1) * BLOCK, self.length) - first, first)
            self.bytes_read += len(data)
            for i in range(missing[0], missing[-1] + 1):
                self.blocks[i] = data[i * BLOCK - first : (i + 1) * BLOCK - first]
        skip = at % BLOCK
        return b"".join(self.blocks[i] for i in wanted)[skip : skip + max(0, end - at)]


@dataclass
class Files(InputPartition):
    """Path and length of some files."""

    files: list[tuple[str, int]]


class HeaderSource(DataSource):
    """`photo_headers`: a row for each photo below `path`, with the tags of its header. `suffixes` (comma-separated), and `taskBytes`, what
    a task reads and opens at most."""

    @classmethod
    def name(cls) -> str:
        return "photo_headers"

    def schema(self) -> str:
        from trailframe.sources.photos import SCHEMA

        return SCHEMA + ", length long, bytes_read long"

    def reader(self, schema) -> HeaderReader:
        return HeaderReader(self.options, ".jpg,.jpeg")


class FileReader(DataSourceReader):
    """Files below the option `path` with one of `suffixes`, dealt to tasks of about `taskBytes`: a file counts for its opening and what is
    read of it, whatever its length."""

    def __init__(self, options: dict[str, str], suffixes: str):
        self.path = options["path"]
        self.suffixes = tuple(options.get("suffixes", suffixes).lower().split(","))
        self.most = int(options.get("taskBytes", str(64 << 20)))

    def partitions(self) -> list[Files]:
        system, inside, _ = located(self.path)
        found = system.get_file_info(fs.FileSelector(inside, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name.lower().endswith(self.suffixes) and not f.base_name.startswith(("_", ".")))
        out, held, cost = [], [], 0
        for path, size in files:
            held.append((path, size))
            cost += OPENING + min(size, TOUCHED)
            if cost >= self.most:
                out.append(Files(held))
                held, cost = [], 0
        return [*out, Files(held)] if held or not out else out

    def opened(self, partition: Files) -> Iterator[tuple[str, Ranged]]:
        """Path, as Spark lists it, and contents of each file."""
        system, _, prefix = located(self.path)
        for path, size in partition.files:
            with system.open_input_file(path) as file:
                yield prefix + path, Ranged(file, size)


class HeaderReader(FileReader):
    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from trailframe.sources.photos import NAMES, TYPES, tags

        names, types = [*NAMES, "length", "bytes_read"], [*TYPES, pa.int64(), pa.int64()]
        rows = []
        for path, read in self.opened(partition):
            rows.append((path, *tags(read), read.length, read.bytes_read))
            if len(rows) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)
                rows = []
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


@dataclass
class Written(WriterCommitMessage):
    folder: str
    place: str
    files: int
    bytes: int


class MediaSink(DataSource):
    """`media_files`: writes a file for each row (path string, relative; content binary) below the option `path`. Tasks write to a folder of
    their own attempt; the commit moves the folder of each task that counts to its place, `part-<task>-<job>/`, with one rename a task, and
    removes the rest. So an attempt that failed, or ran beside another, leaves nothing. Append keeps what is there; overwrite replaces it.
    Rows without a path or content are left out; of equal paths in a task the last row stays."""

    @classmethod
    def name(cls) -> str:
        return "media_files"

    def writer(self, schema, overwrite: bool) -> MediaWriter:
        if [f.name for f in schema.fields] != ["path", "content"]:
            raise ValueError("columns path and content are needed")
        return MediaWriter(self.options["path"], overwrite)


class MediaWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex[:12]

    def _stage(self, inside: str) -> str:
        return f"{inside.rstrip('/')}/_staged-{self.job}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, inside, _ = located(self.path)
        task, local = TaskContext.get(), isinstance(system, fs.LocalFileSystem)
        folder = f"{self._stage(inside)}/{task.partitionId()}-{task.taskAttemptId()}"
        made, files, size = set(), 0, 0
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                if path is None or not content.is_valid:
                    continue
                if path.startswith("/") or ".." in path.split("/"):
                    raise ValueError(f"no path below the folder: {path}")
                target = f"{folder}/{path}"
                parent = target.rsplit("/", 1)[0]
                if parent not in made:
                    system.create_dir(parent)
                    made.add(parent)
                with open(target, "wb") if local else system.open_output_stream(target) as out:  # a local file opens sooner by itself
                    out.write(content.as_buffer())
                files, size = files + 1, size + len(content.as_buffer())
        return Written(folder, f"part-{task.partitionId():05d}-{self.job}", files, size)

    def commit(self, messages: list[Written | None]) -> None:
        system, inside, _ = located(self.path)
        if self.overwrite:
            stage = self._stage(inside)
            for info in system.get_file_info(fs.FileSelector(inside, allow_not_found=True)):
                if info.path.rstrip("/") != stage:
                    (system.delete_dir if info.type == fs.FileType.Directory else system.delete_file)(info.path)
        system.create_dir(inside)
        for m in messages:
            if m is not None and m.files:
                system.move(m.folder, f"{inside.rstrip('/')}/{m.place}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, inside, _ = located(self.path)
        stage = self._stage(inside)
        if system.get_file_info(stage).type == fs.FileType.Directory:
            system.delete_dir(stage)


def registered(spark: SparkSession) -> Callable:
    """The session with both sources known; returns its reader."""
    spark.dataSource.register(HeaderSource)
    spark.dataSource.register(MediaSink)
    return spark.read
