"""Session helpers: where intermediate tables go and how they are pinned."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Whether Spark removes the shuffle files of a query when it has ended.
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_pinned: list[str] = []
_bucketed: dict[str, str] = {}


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "poseweave") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The shared folder intermediate tables are written to.

    A cluster names it in ``spark.checkpoint.dir``.  Where that is unset, a folder below the session's
    warehouse is used: the warehouse is always set and, like the inputs, seen by every executor.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    named = named or spark.sparkContext.getCheckpointDir()
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_pinned"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder that :func:`release` removes."""
    _pinned.append(new_path(spark, label))
    return _pinned[-1]


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that end within leave no shuffle files: what they have written is all that is read later."""
    before = spark.conf.get(CLEANUP_KEY, None)
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP_KEY) if before is None else spark.conf.set(CLEANUP_KEY, before)


def pin(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts lineage for iterative operators, survives executor loss (the files do not live on
    executors) and hands the next stage exact table sizes.  The disk its shuffles took is free again when it returns.
    """
    path = scratch_path(df.sparkSession, label)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucket_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pin_bucketed(df: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """Like :func:`pin`, in as many buckets of ``keys`` as a shuffle has partitions.

    Joins on the keys, and on more columns with a side dealt by ``keys`` alike, read the table without shuffling it again.
    """
    spark = df.sparkSession
    path, count = scratch_path(spark, label), bucket_count(spark)
    _bucketed[path] = f"pinned_{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.repartition(count, *keys).write.format("parquet").bucketBy(count, *keys).sortBy(*keys).option("path", path).saveAsTable(_bucketed[path])
    return spark.table(_bucketed[path])


def pinned_paths() -> list[str]:
    """Folders written by ``pin`` or ``pin_bucketed`` or handed out by ``scratch_path`` and not yet removed, oldest first."""
    return list(_pinned)


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names of what lies in a folder; none if there is no such folder."""
    files, where = _file_system(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(where)) if files.exists(where) else []


def remove(spark: SparkSession, path: str) -> None:
    files, where = _file_system(spark, path)
    files.delete(where, True)


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Remove pinned tables, all by default.  Call it when the frames read from them have been consumed."""
    for path in list(_pinned if paths is None else paths):
        if path in _bucketed:
            spark.sql(f"DROP TABLE IF EXISTS {_bucketed.pop(path)}")
        remove(spark, path)
        if path in _pinned:
            _pinned.remove(path)
