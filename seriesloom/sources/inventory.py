"""Folder trees of image files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.operators.summarise import count_instances


def series_inventory(files: DataFrame, path: str = "path", keep: Sequence[str] = ()) -> DataFrame:
    """(study_uid, series_uid, file_name, file_path, keep…, number_of_images) of a table of file paths.

    Study, series and file are the last three parts of the path; a path of fewer parts has NULL in place of
    what it lacks, a NULL path in all of them. The table may come from any listing, a store's manifest
    among them, and is only ever a distributed table.
    """
    part = F.split(path, "/")

    def from_end(n: int):
        return F.get(part, F.size(part) - n)

    named = files.select(
        from_end(3).alias("study_uid"),
        from_end(2).alias("series_uid"),
        from_end(1).alias("file_name"),
        F.col(path).alias("file_path"),
        *keep,
    )
    return count_instances(named)


def scan_series_inventory(
    spark: SparkSession, paths: str | Sequence[str], pattern: str = "*", recursive: bool = True
) -> DataFrame:
    """``series_inventory`` of every matching file below ``paths``, with its length; contents are never read.

    Spark lists many roots as a job of their own, so a large tree is best given as its first-level folders.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return series_inventory(reader.load(paths).select("path", "length"), keep=["length"])
