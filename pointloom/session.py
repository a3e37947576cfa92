"""Session settings and the few helpers that depend on the running session."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Settings the operators rely on for right answers (time zone) or for scale (AQE).
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Lets AQE split hot keys of outer joins even when that adds a shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Rows split by outcome go to a few open files instead of being sorted first.
    "spark.sql.maxConcurrentOutputFileWriters": "8",
}

#: Rows that go to a Python worker in one piece where they are whole texts.
WORKER_ROWS = 512

#: Largest row count that is ever broadcast by explicit hint.
BROADCAST_ROWS = 200_000


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings above to an existing session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def require_utc(spark: SparkSession) -> None:
    """Unzoned times mean UTC, so any other session zone would shift them."""
    if spark.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC", "Z", "+00:00"):
        raise ValueError("Set spark.sql.session.timeZone to UTC (pointloom.configure does this)")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a purely local session without that setting gets a folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("Set spark.checkpoint.dir to a folder every executor can reach")
            folder = tempfile.mkdtemp(prefix="pointloom-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def scratch_folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, where every executor can write."""
    return f"{checkpoint_folder(spark)}/pointloom-{uuid.uuid4().hex}"


class Stages:
    """Rows kept as Parquet in the shared folder, by name, until they have served."""

    def __init__(self, spark: SparkSession):
        self._spark, self._folders = spark, {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """Write the rows; the same rows, read from there."""
        folder = scratch_folder(self._spark)
        df.write.option("compression", "zstd").parquet(folder)
        self._folders[name] = folder
        return self._spark.read.parquet(folder)

    def drop(self, *names: str) -> None:
        """Delete rows that nothing reads any more."""
        for name in names:
            path = self._spark._jvm.org.apache.hadoop.fs.Path(self._folders.pop(name))
            path.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """From now on rows go to Python workers ``WORKER_ROWS`` at a time at most, so that neither side holds thousands of texts.

    The setting counts when a table is written, not when it is built, so it stays with the session.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(name))
    if not 0 < rows <= WORKER_ROWS:
        spark.conf.set(name, str(WORKER_ROWS))


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a query go when it ends, not when the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage into the shared checkpoint folder, eagerly."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def hint_if_small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast only when the counted rows stay under the bound."""
    return F.broadcast(df) if rows <= limit else df
