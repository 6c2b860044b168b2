"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings for skewed keys and many small groups.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot key even where that costs one more exchange after the join
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}

# bytes of a generated method that the JVM still compiles
_METHOD = ("spark.sql.codegen.hugeMethodLimit", "8000")

_tracked: ContextVar[list[str] | None] = ContextVar("scratch_paths", default=None)


def configure(spark: SparkSession) -> SparkSession:
    """Apply the recommended runtime settings to a session."""
    for key, value in RECOMMENDED.items():
        spark.conf.set(key, value)
    return spark


def compile_wide_rows(spark: SparkSession) -> None:
    """Let projections of many columns run as compiled code.

    Spark writes a stage's columns into one method and the JVM interprets methods over 8,000 bytes for good. With
    this limit such a stage is made of smaller methods. It stays set in the session, as tables are evaluated
    later; a limit the session already has is left alone.
    """
    if spark.conf.get(_METHOD[0], None) is None:
        spark.conf.set(*_METHOD)


def scratch_base(spark: SparkSession) -> str:
    """The folder that all executors share.

    ``spark.checkpoint.dir``, else the folder given to ``SparkContext.setCheckpointDir``, else, on a
    local master only, a temporary folder of this machine. A cluster without either is refused, as its
    executors would write to their own disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return tempfile.mkdtemp(prefix="seriesloom-")
    raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    path = f"{scratch_base(spark)}/seriesloom/{name}-{uuid.uuid4().hex}"
    if (tracked := _tracked.get()) is not None:
        tracked.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete, on leaving, every scratch table made inside; results must be written or collected by then."""
    token = _tracked.set([])
    try:
        yield
    finally:
        paths = _tracked.get()
        _tracked.reset(token)
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts the lineage of a table that is read many times: a lost executor re-reads files instead of
    replaying the plan, and later scans still read only the columns they need.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
