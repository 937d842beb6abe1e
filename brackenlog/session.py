"""Session defaults and the shared folder for checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def builder(app: str = "brackenlog"):
    """Session builder with the settings the operators are tuned for.

    Every value can be overridden by the cluster; nothing in the library reads them back
    except the shuffle width and the checkpoint folder.
    """
    return (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Per-block summaries are a few dozen bytes per 128 MB of log. AQE compares their
        # real size with this bound and keeps the sort-merge join beyond it.
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", "64MB")
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster.

    Only a local session without the setting gets a temporary folder of its own.
    """
    context = spark.sparkContext
    found = spark.conf.get(CHECKPOINT_CONF, None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
        found = tempfile.mkdtemp(prefix="brackenlog-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


_named: ContextVar[list[str] | None] = ContextVar("named", default=None)


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, not yet existing folder below the shared one."""
    folder = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if (named := _named.get()) is not None:
        named.append(folder)
    return folder


@contextmanager
def fresh_dirs() -> Iterator[list[str]]:
    """The folders that ``fresh_dir`` names inside, in this thread; ``discard`` them when no frame reads them."""
    folders: list[str] = []
    token = _named.set(folders)
    try:
        yield folders
    finally:
        _named.reset(token)


def discard(spark: SparkSession, folders: Sequence[str]) -> None:
    """Deletes folders below the shared one."""
    context = spark.sparkContext
    for folder in folders:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """The frame, written to the shared folder and read again, which cuts its lineage."""
    folder = fresh_dir(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, size: str = "2m") -> None:
    """Bounds the bytes of an Arrow batch from now on, unless the session has a bound of its own.

    Spark's bound is 64 MB, and a batch is held several times over: as it is built and as it is
    read, by the executor and by the worker, for each core.
    """
    if spark.conf.get(BATCH_CONF, None) is None:
        spark.conf.set(BATCH_CONF, size)
