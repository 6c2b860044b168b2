"""Jobs from files to files: splitting a table and joining a target to one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.operators.joins import merge_target
from seriesloom.operators.split import split_by_id
from seriesloom.session import materialise
from seriesloom.sources.tables import read_any, write_table


def split_files(
    spark: SparkSession,
    paths: str | Sequence[str],
    outputs: Sequence[str],
    ratio: float = 0.8,
    id_columns: str | Sequence[str] | None = None,
    seed: int = 42,
) -> None:
    """Write the tables at ``paths`` as two, of about ``ratio`` and the rest, in the kinds that the outputs' suffixes name.

    With ``id_columns`` no id is in both. Without, single rows are split; equal rows are told apart by the
    place they are read at, so the table is stored first and every row gets its own number.
    """
    if len(outputs) != 2:
        raise ValueError("a split needs two outputs")
    table = read_any(spark, paths, keys=None)
    if id_columns is None:
        table = materialise(table.withColumn("_row", F.monotonically_increasing_id()), "rows")
    parts = split_by_id(table, "_row" if id_columns is None else id_columns, ratio, seed)
    for part, path in zip(parts, outputs, strict=True):
        write_table(part.drop("_row") if id_columns is None else part, path)


def merge_target_files(
    spark: SparkSession,
    paths: str | Sequence[str],
    target_paths: str | Sequence[str],
    on: Sequence[str],
    output: str,
    target: str = "class",
) -> DataFrame:
    """Write the tables at ``paths`` with the target that the tables at ``target_paths`` have for them; the written table.

    Rows without a target are left out.
    """
    merged = merge_target(read_any(spark, paths, keys=None), read_any(spark, target_paths, keys=None), on, target)
    write_table(merged, output)
    return read_any(spark, output, keys=None)
