"""Tables written to the cluster's shared folder, to end lineage and free shuffle files."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Input for each core below which a table is dealt out anew before work that costs more than a shuffle.
SPREAD_BYTES = 64 << 20
#: Folders to delete at the end of the process, with the Java objects that do it.
_LEFT: dict[str, tuple] = {}
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a local one is made only where none is set and all runs in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        context = spark.sparkContext
        jdir = context._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            path = jdir.get()
        elif context.master.startswith("local") and not context.master.startswith("local-cluster"):
            path = "file://" + tempfile.mkdtemp(prefix="harrow-checkpoint-")
            context.setCheckpointDir(path)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted at the end of the process at the latest."""
    path = f"{shared_dir(spark)}/harrow/{name}-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    _LEFT[path] = (p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p)
    return path


def forget(path: str) -> None:
    """Delete what is at a path of :func:`scratch`."""
    if path in _LEFT:
        fs, p = _LEFT.pop(path)
        fs.delete(p, True)


@atexit.register
def _forget_all() -> None:
    for path in list(_LEFT):
        with suppress(Exception):  # the JVM may have gone first
            forget(path)


@contextmanager
def _shuffle_files_dropped(spark: SparkSession):
    """Shuffle files of a finished write go at once, so that stages do not add up on disk.

    The setting is the session's: a query that starts meanwhile in another thread
    frees its own shuffle files at its own end too, and no others.
    """
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


@contextmanager
def _rows_at_once(spark: SparkSession, rows: int | None):
    """Batches of at most so many rows for Python, where rows are large; the setting is the session's."""
    before = spark.conf.get(_BATCH, None)
    if rows:
        spark.conf.set(_BATCH, min(rows, max(0, int(before or 0)) or rows))
    try:
        yield
    finally:
        if rows and before is None:
            spark.conf.unset(_BATCH)
        elif rows:
            spark.conf.set(_BATCH, before)


def staged(df: DataFrame, name: str, schema: StructType | None = None, rows_at_once: int | None = None) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back, in another ``schema`` of the same layout if one is given.

    Python functions in it get at most ``rows_at_once`` rows in a batch.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    with _shuffle_files_dropped(spark), _rows_at_once(spark, rows_at_once):
        df.write.parquet(path)
    out = spark.read.schema(schema or df.schema).parquet(path)
    out._harrow_path = path
    return out


def drop_staged(*frames: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in frames:
        forget(getattr(df, "_harrow_path", ""))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it is small: a few files of one row group each are one task each otherwise."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPREAD_BYTES else df


def over_all(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by keys into as many parts as a shuffle has at the most, however small: for work that costs far more than a shuffle."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)
