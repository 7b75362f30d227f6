"""The folder that driver and executors share, for rows that are written to be read again."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a folder of the warehouse if the master is local; on a cluster that is an error, as
    machines' own folders are not shared."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: a folder that all machines share is needed")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def settled(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder. The files go when nothing refers to the rows any more."""
    context = df.sparkSession.sparkContext
    context._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def _deleted(spark: SparkSession, name: str) -> None:
    """Folders up to two levels below are deleted by tasks, as there may be very many files in them; then the rest."""
    import pyarrow as pa

    from trailframe.sources import media

    def folders(path: str) -> list[str]:
        return [e[0] for e in media.entries(path) if e[1] is None]

    try:
        inner = [y for x in folders(name) for y in folders(x) or [x]]
    except (pa.ArrowInvalid, FileNotFoundError):  # only Spark opens it, or nothing was written
        return

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, inside, _ = media.located(path)
                try:
                    system.delete_dir(inside)
                except FileNotFoundError:  # by an attempt before
                    pass
            yield batch

    if len(inner) > 1:
        parts = spark.createDataFrame([(x,) for x in inner], "path string").repartition(min(len(inner), media.tasks(spark)))
        parts.mapInArrow(run, "path string").write.format("noop").mode("overwrite").save()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A new folder in the shared one, deleted at the end."""
    name = f"{shared_folder(spark)}/scratch/{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        yield name
    finally:
        try:
            _deleted(spark, name)
        finally:
            files.delete(path, True)
