"""Intermediate tables whose shuffles don't outlive them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from seriesloom.session import materialise

FILES_PER_CORE = 3
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """``materialise``, after which the shuffle files of the job that wrote the table are given back.

    While the job runs they are kept, so lost executors are made up for as ever. ``narrow`` is for tables
    of few small columns: they are written by no more than FILES_PER_CORE tasks per core of the cluster,
    as a file per shuffle partition costs more than its rows.
    """
    if narrow:
        df = df.coalesce(FILES_PER_CORE * df.sparkSession.sparkContext.defaultParallelism)
    conf = df.sparkSession.conf
    before = conf.get(_CLEAN, None)
    conf.set(_CLEAN, "true")
    try:
        return materialise(df, name)
    finally:
        conf.unset(_CLEAN) if before is None else conf.set(_CLEAN, before)
