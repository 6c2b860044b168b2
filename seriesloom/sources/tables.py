"""Delimited and parquet tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.operators.clean import rename_columns, underscore_names, union_vertical
from seriesloom.operators.joins import auto_match_columns
from seriesloom.operators.summarise import summarise
from seriesloom.roles import HEADER_TAGS, SERIES_KEYS
from seriesloom.sources.nested_json import scan_nested_json

_SEPARATORS = {"csv": ",", "tsv": "\t"}
# RFC 4180 quoting; spaces belong to the value
_DELIMITED = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def suffix_of(path: str) -> str:
    return path.rstrip("/").rsplit(".", 1)[-1].lower()


def scan_delimited(
    spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] | None = None, multiline: bool = False
) -> DataFrame:
    """CSV or TSV (by suffix) as strings; surplus fields are cut, missing ones NULL, names underscored.

    With ``columns`` the header row is skipped without being read. ``multiline`` allows line breaks in
    quoted cells, at the price of unsplittable files.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    reader = spark.read.options(**_DELIMITED, sep=_SEPARATORS[suffix_of(paths[0])], mode="PERMISSIVE")
    # a mark no cell holds: an empty cell is NULL, a quoted empty one is an empty string
    reader = reader.option("nullValue", "\x00")
    if multiline:
        reader = reader.option("multiLine", "true")
    if columns is not None:
        reader = reader.schema(", ".join(f"`{c}` string" for c in columns)).option("enforceSchema", "true")
    return underscore_names(reader.csv(paths))


def scan_parquet(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Parquet tables, names underscored."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return underscore_names(spark.read.parquet(*paths))


def write_table(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: Sequence[str] = ()) -> None:
    """Write by suffix: ``.csv``, ``.tsv`` or ``.parquet`` (a folder of part files)."""
    suffix = suffix_of(path)
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if suffix == "parquet":
        writer.parquet(path)
    elif suffix in _SEPARATORS:
        writer.options(**_DELIMITED, sep=_SEPARATORS[suffix]).csv(path)
    else:
        raise ValueError(f"unknown output suffix: {path}")


def read_any(
    spark: SparkSession,
    paths: str | Sequence[str],
    keys: Sequence[str] | None = SERIES_KEYS,
    mapping: Mapping[str, str] | Iterable[str] | None = None,
    auto_match: bool = False,
    multiline: bool = False,
    whole_file: bool = False,
) -> DataFrame:
    """Read paths of any supported type, stack them, rename, and fold them by ``keys`` unless None.

    Types are stacked in the order delimited, parquet, JSON, whatever the order of the paths. Delimited
    and JSON cells are text; beside them the cells of parquet tables become text too. Tables of different
    columns are an error, their order is that of the first. ``multiline`` allows line breaks in delimited
    cells, ``whole_file`` takes one JSON document per file, indented or not, instead of one per line.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    kinds: dict[str, list[str]] = {"csv": [], "tsv": [], "parquet": [], "json": []}
    for path in paths:
        if suffix_of(path) not in kinds:
            raise ValueError(f"input must be csv, tsv, parquet or json: {path}")
        kinds[suffix_of(path)].append(path)
    frames = [scan_delimited(spark, p, multiline=multiline) for p in (*kinds["csv"], *kinds["tsv"])]
    frames += [scan_parquet(spark, p) for p in kinds["parquet"]]
    frames += [scan_nested_json(spark, p, whole_file=whole_file) for p in kinds["json"]]
    if not frames:
        raise ValueError("no input paths")
    if len(frames) > len(kinds["parquet"]) > 0:
        frames = [frame.select(*[F.col(c).cast("string").alias(c) for c in frame.columns]) for frame in frames]
    first = frames[0].columns
    frames = [frame.select(*first) if sorted(frame.columns) == sorted(first) else frame for frame in frames]
    table = union_vertical(frames)
    if mapping is not None:
        table = rename_columns(table, mapping)
    if auto_match:
        matched, missing = auto_match_columns(table, list(HEADER_TAGS))
        if missing:
            raise ValueError(f"could not match columns: {missing}")
        table = rename_columns(table, matched)
    return table if keys is None else summarise(table, keys)
