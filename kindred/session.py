"""Session helpers: a local test session and reliable materialization."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int | None = None) -> SparkSession:
    """Session for tests and benches; on a cluster the caller brings its own."""
    parts = shuffle_partitions or (cores if isinstance(cores, int) else 8)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("kindred")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only for local masters."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if sc.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[sc.applicationId] = tempfile.mkdtemp(prefix="kindred-")
    return _LOCAL_FOLDERS[sc.applicationId]


_LOCAL_FOLDERS: dict[str, str] = {}


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries inside drop their shuffle files when they end, not when the driver's garbage collection finds them."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def pin(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write a table that several later steps read, and go on from the written copy.

    With ``by``, rows of one value of that column are written by one task to one folder, so that a
    reader of few values opens only theirs; meant for columns whose values hold few rows each.

    Cuts the lineage, survives lost executors, and the Parquet copy still prunes columns and
    carries true sizes for join planning. The copy is dropped when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/kindred-pins/{uuid.uuid4().hex}"
    with short_shuffles(spark):
        if by is None:
            df.write.parquet(path)
        else:
            df.repartition(by).write.partitionBy(by).parquet(path)
    file_system, target = hadoop_path(spark, path)
    file_system.deleteOnExit(target)
    pinned = spark.read.schema(df.schema).parquet(path)
    pinned._kindred_pin = path
    for scope in getattr(_SCOPES, "open", []):
        scope.append(pinned)
    return pinned


_SCOPES = threading.local()


@contextmanager
def pin_scope() -> Iterator[None]:
    """Drops every copy that :func:`pin` wrote inside, once the block ends, however it ends.

    For work whose results are written elsewhere, such as a micro-batch.
    """
    scopes = _SCOPES.__dict__.setdefault("open", [])
    mine: list[DataFrame] = []
    scopes.append(mine)
    try:
        yield
    finally:
        scopes[:] = [s for s in scopes if s is not mine]
        for df in mine:
            release(df)


def release(df: DataFrame) -> None:
    """Drop the written copy behind a pinned table that nothing reads any more."""
    path = getattr(df, "_kindred_pin", None)
    if path is not None:
        file_system, target = hadoop_path(df.sparkSession, path)
        file_system.delete(target, True)


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) handles for existence checks and deletes on any storage."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target
