"""Session settings and the shared scratch area used to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Whether the shuffle files of a query go when it ends.
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Folders made for local sessions that name none, by application id.
_local_roots: dict[str, str] = {}


def local_session(app: str = "harborline", cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by the session; a temporary one only in local mode."""
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="harborline-")
        atexit.register(shutil.rmtree, _local_roots[app], ignore_errors=True)
    return _local_roots[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the scratch root."""
    return f"{scratch_root(spark)}/harborline/{label}-{uuid.uuid4().hex}"


def spool(df: DataFrame, label: str) -> DataFrame:
    """Write a DataFrame to the scratch area and read it back.

    The result has no lineage to recompute when an executor is lost, and it has a
    file size, so Catalyst broadcasts it in a later join only while it is really
    below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spool_parts(parts: Iterable[DataFrame], label: str) -> DataFrame:
    """Write DataFrames of one schema to one spooled table, one after the other."""
    path = ""
    for df in parts:
        path = path or scratch_path(df.sparkSession, label)
        df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slice_of(key: str, slices: int) -> Column:
    """The slice of its table, of so many, that a row belongs to: by a hash other than that of Spark's exchanges.

    A job that takes slice after slice moves every row as often, but a shuffle holds one slice.
    """
    return F.pmod(F.xxhash64(key), F.lit(slices))


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a query made inside go when it ends.

    Else they stay until the driver happens to collect its garbage.
    """
    before = spark.conf.get(CLEANUP_KEY, None)
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP_KEY)
        else:
            spark.conf.set(CLEANUP_KEY, before)


def release(*tables: DataFrame) -> None:
    """Delete the files of spooled tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        inside = f"{scratch_root(spark)}/harborline/"
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            # Only tables of the scratch area, never a user's.
            if inside.split(":", 1)[-1].lstrip("/") in folder:
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
