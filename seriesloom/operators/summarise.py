"""Folding instance rows into one row per series or study."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.clean import null_safe_join
from seriesloom.roles import MISSING, SERIES_KEYS, STANDARD, STUDY_KEYS, Roles
from seriesloom.session import compile_wide_rows

_COUNTS = ("number_of_images", "number_of_frames")


def clean_cell(value: Column) -> Column:
    """A cell that is exactly ``nan`` and every backslash or semicolon become the missing mark."""
    return F.regexp_replace(value, r"^nan$|\\|;", MISSING)


def distinct_text(name: str, separator: str = " ", clean: bool = True) -> Column:
    """Aggregate: distinct values of a column as one sorted, joined text.

    The set is collected from raw values and cleaned afterwards, so the pattern runs once per
    distinct value and not once per row; map-side aggregation keeps what is shuffled to sets.
    """
    values = F.collect_set(F.coalesce(F.col(name).cast("string"), F.lit(MISSING)))
    if clean:
        values = F.array_distinct(F.transform(values, clean_cell))
    return F.array_join(F.array_sort(values), separator)


def median_of_int(name: str) -> Column:
    # counts read from text may look like floats (``24.0``); unreadable cells are no count
    return F.percentile(F.col(name).try_cast("double").try_cast("int"), F.lit(0.5))


# rows of a group up to which its header combinations surely fit a task
SMALL_GROUP = 100_000


def has_large_group(df: DataFrame, keys: Sequence[str], rows: int = SMALL_GROUP) -> bool:
    """Whether any group has more than so many rows. Reads the key columns only."""
    return not df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows).isEmpty()


def summarise(
    df: DataFrame,
    keys: Sequence[str] = SERIES_KEYS,
    roles: Roles = STANDARD,
    columns: Sequence[str] | None = None,
    large: bool | None = None,
) -> DataFrame:
    """One row per group: joined distinct text, mean image features, median image count.

    ``columns`` names the columns that are folded beside the keys and the counts, all of them if None: ids
    and paths that nobody reads need no set. Keys the table lacks are left out; NULL keys form a group of
    their own. ``number_of_images`` is the median of that column, else of ``number_of_frames``, else the row count.

    Needs one shuffle. Rows that agree in all their cells are one header combination: a group gathers the set
    of its combinations, one hash per row instead of one per cell and mostly few per task before the shuffle,
    and every column takes its distinct values from that set. A group's combinations may be as many as its
    rows, so where one has more than SMALL_GROUP rows (``large``; None: counted here, over the key columns),
    every column gathers a set of its own instead, which holds distinct values only. Both give the same table.
    """
    compile_wide_rows(df.sparkSession)
    present = [k for k in keys if k in df.columns]
    if not present:
        raise ValueError(f"none of the group columns {list(keys)} is present")
    folded = [c for c in df.columns if c not in present and c not in _COUNTS and (columns is None or c in columns)]
    images = [c for c in folded if c in roles.image]
    texts = [c for c in folded if c not in roles.image]
    source = next((c for c in _COUNTS if c in df.columns), None)
    count = median_of_int(source) if source else F.count(F.lit(1)).cast("double")
    means = {c: F.avg(F.col(c).try_cast("double")) for c in images}
    if not texts or (has_large_group(df, present) if large is None else large):
        measures = {c: means[c] if c in means else distinct_text(c) for c in folded}
        return df.groupBy(*present).agg(*[measures[c].alias(c) for c in folded], count.alias("number_of_images"))
    cells = [F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(f"c{i}") for i, c in enumerate(texts)]
    sets = df.groupBy(*present).agg(
        F.collect_set(F.struct(*cells)).alias("_cells"), *[means[c].alias(c) for c in images], count.alias("number_of_images")
    )
    out = {c: _joined(F.col("_cells")[f"c{i}"]) for i, c in enumerate(texts)} | {c: F.col(c) for c in images}
    return sets.select(*present, *[out[c].alias(c) for c in folded], "number_of_images")


def _joined(values: Column) -> Column:
    """Raw values of a group's combinations to clean, distinct, sorted, joined text; a value is cleaned once."""
    clean = F.array_distinct(F.transform(F.array_distinct(values), clean_cell))
    return F.array_join(F.array_sort(clean), " ")


def summarise_study(df: DataFrame, roles: Roles = STANDARD) -> DataFrame:
    """As ``summarise`` by study; series ids become joined text."""
    return summarise(df, STUDY_KEYS, roles)


def join_unique(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], separator: str = "|"
) -> DataFrame:
    """Distinct raw values of each column joined over a whole series."""
    return df.groupBy(*keys).agg(*[distinct_text(c, separator, clean=False).alias(c) for c in columns])


def count_instances(
    df: DataFrame, keys: Sequence[str] = ("study_uid", "series_uid"), name: str = "number_of_images"
) -> DataFrame:
    """Stamp every row with the number of rows in its series.

    Counted by aggregation and joined back: unlike a window, no task ever has to hold one whole series.
    Rows with NULL keys form series of their own.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    return null_safe_join(df.drop(name), sizes, keys)


def distinct_ids(df: DataFrame, column: str = "study_uid") -> DataFrame:
    return df.select(column).distinct()
