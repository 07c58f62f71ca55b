"""Session settings and the shared folder that durable intermediate results go to."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A user or response with a huge share of the rows is normal here, so a
    # skewed join is split even where that costs a later shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Checkpoint files go when nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: A batch adds its changes to the state's files instead of the whole state once more.
CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Lists that new folders are noted in.
_noting: list[list[str]] = []


def session(master: str | None = None, app: str = "parley", **settings: str) -> SparkSession:
    """Get or create a session with the settings the jobs are tuned for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in {**SETTINGS, **settings}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local session may make its own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="parley-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A path below the shared folder that nothing has written to yet; it goes with the application."""
    folder = f"{shared_folder(spark)}/parley-{purpose}-{uuid.uuid4().hex}"
    system, path = _file_system(spark, folder)
    system.deleteOnExit(path)
    for noted in _noting:
        noted.append(folder)
    return folder


@contextmanager
def new_folders() -> Iterator[list[str]]:
    """The folders that ``new_folder`` gives inside the block."""
    noted: list[str] = []
    _noting.append(noted)
    try:
        yield noted
    finally:
        _noting[:] = [other for other in _noting if other is not noted]


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of ``new_folder`` whose rows no job will read again."""
    system, path = _file_system(spark, folder)
    system.delete(path, True)


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably, so that later reads neither recompute nor reshuffle it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def use_rocksdb_state(spark: SparkSession) -> None:
    """Arbitrary state needs the RocksDB provider, which also keeps state off the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    spark.conf.set(CHANGELOG, "true")
