"""Seeded splits, subsets and folds without a global sort.

Rows are ordered by the md5 of their id and the seed. How many rows fall below a cut is known from
counts per hash prefix, so only the prefix bucket holding the cut is ranked, and the split itself is a
comparison of each row's hash with the cut: no join, no shuffle of the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PREFIX = 4  # hex digits, so at most 65,536 buckets however many ids there are


def _position(key: Sequence[str], seed: int) -> Column:
    """Place of an id in the seeded order; the id itself breaks ties."""
    ident = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key])
    digest = F.md5(F.concat_ws("|", ident, F.lit(str(seed))))
    return F.struct(digest.alias("hash"), ident.alias("id"))


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _cuts(
    df: DataFrame, key: Sequence[str], seed: int, ranks: Callable[[Column], list[Column]], stratum: Column
) -> DataFrame:
    """(_stratum, cuts): hash positions at the given ranks, ranks counted from 1 per stratum."""
    ids = (
        df.select(stratum.alias("_stratum"), _position(key, seed).alias("_at"))
        .distinct()
        .withColumn("_bucket", F.substring("_at.hash", 1, _PREFIX))
    )
    # at most 65,536 rows per stratum from here on
    sizes = ids.groupBy("_stratum", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("_stratum")
    upto = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    wanted = F.array(*[r.cast("bigint") for r in ranks(F.col("_total"))])
    edges = (
        sizes.withColumns({"_high": F.sum("_n").over(upto), "_total": F.sum("_n").over(whole)})
        .withColumn("_rank", F.explode(F.array_distinct(wanted)))
        .filter((F.col("_rank") > F.col("_high") - F.col("_n")) & (F.col("_rank") <= F.col("_high")))
        .select("_stratum", "_bucket", (F.col("_rank") - (F.col("_high") - F.col("_n"))).alias("_nth"))
    )
    # `edges` holds one row per cut: few, whatever the data size
    inside = ids.join(F.broadcast(edges.select("_stratum", "_bucket").distinct()), ["_stratum", "_bucket"], "left_semi")
    nth = F.row_number().over(Window.partitionBy("_stratum", "_bucket").orderBy("_at"))
    found = inside.withColumn("_nth", nth.cast("bigint")).join(
        F.broadcast(edges), ["_stratum", "_bucket", "_nth"]
    )
    return found.groupBy("_stratum").agg(F.array_sort(F.collect_list("_at")).alias("cuts"))


def _fold_ranks(k: int) -> Callable[[Column], list[Column]]:
    """Last ranks of folds 0..k-2 when n ids go into k folds, the first n % k of them one larger."""

    def ranks(total: Column) -> list[Column]:
        return [F.floor(total / k) * i + F.least(F.lit(i), total % k) for i in range(1, k)]

    return ranks


def _above(cuts: Column, position: Column, how_many: int) -> Column:
    """Number of cuts below a position."""
    parts = [F.coalesce(position > F.get(cuts, F.lit(i)), F.lit(False)).cast("int") for i in range(how_many)]
    return sum(parts[1:], parts[0])


def _first_part(df: DataFrame, key: list[str], seed: int, count: Callable[[Column], Column]) -> DataFrame:
    one = F.lit(0)
    cuts = _cuts(df, key, seed, lambda total: [F.least(count(total), total)], one)
    return (
        df.withColumns({"_cuts": cuts.select("cuts").scalar(), "_at": _position(key, seed)})
        .withColumn("_first", F.coalesce(F.col("_at") <= F.get("_cuts", F.lit(0)), F.lit(False)))
        .drop("_cuts", "_at")
    )


def tag_split(df: DataFrame, key: str | Sequence[str], ratio: float = 0.8, seed: int = 42, name: str = "part") -> DataFrame:
    """Column ``part``: ``a`` for exactly int(ratio · n) distinct ids, else ``b``; rows follow their id."""
    tagged = _first_part(df, _keys(key), seed, lambda total: F.floor(F.lit(ratio) * total))
    return tagged.withColumn(name, F.when(F.col("_first"), "a").otherwise("b")).drop("_first")


def split_by_id(df: DataFrame, key: str | Sequence[str], ratio: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Two tables with no id in common."""
    tagged = tag_split(df, key, ratio, seed, "_part")
    a, b = (tagged.filter(F.col("_part") == p).drop("_part") for p in "ab")
    return a, b


def split_rows(df: DataFrame, row_key: str | Sequence[str], ratio: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """As ``split_by_id`` with a key that identifies single rows."""
    return split_by_id(df, row_key, ratio, seed)


def subset_rows(df: DataFrame, row_key: str | Sequence[str], amount: float, seed: int = 42) -> DataFrame:
    """Rows drawn without replacement: above 1 an absolute number, else a fraction."""

    def count(total: Column) -> Column:
        return F.lit(int(amount)) if amount > 1 else F.floor(F.lit(float(amount)) * total)

    return _first_part(df, _keys(row_key), seed, count).filter("_first").drop("_first")


def group_kfold(df: DataFrame, key: str | Sequence[str], k: int = 5, seed: int = 42, name: str = "fold") -> DataFrame:
    """Fold 0..k-1 per distinct id in seeded order; sizes differ by at most one id."""
    keys = _keys(key)
    cuts = _cuts(df, keys, seed, _fold_ranks(k), F.lit(0))
    return (
        df.withColumns({"_cuts": cuts.select("cuts").scalar(), "_at": _position(keys, seed)})
        .withColumn(name, _above(F.col("_cuts"), F.col("_at"), k - 1))
        .drop("_cuts", "_at")
    )


def stratified_kfold(
    df: DataFrame, row_key: str | Sequence[str], target: str, k: int = 5, seed: int = 42, name: str = "fold"
) -> DataFrame:
    """Fold 0..k-1 per row so that every class is spread evenly."""
    keys = _keys(row_key)
    stratum = F.coalesce(F.col(target).cast("string"), F.lit(""))
    cuts = _cuts(df, keys, seed, _fold_ranks(k), stratum)
    # one entry per class
    by_class = cuts.agg(F.map_from_entries(F.collect_list(F.struct("_stratum", "cuts"))).alias("m"))
    return (
        df.withColumn("_map", by_class.scalar())
        .withColumns({"_cuts": F.element_at("_map", stratum), "_at": _position(keys, seed)})
        .withColumn(name, _above(F.col("_cuts"), F.col("_at"), k - 1))
        .drop("_map", "_cuts", "_at")
    )


def leave_one_group_out(df: DataFrame, groups: DataFrame, on: str = "study_uid", group: str = "group", name: str = "fold") -> DataFrame:
    """One fold per group of the map, named by the group; studies outside the map are dropped."""
    return df.join(groups.select(on, F.col(group).alias(name)), on, "inner")


def hash_rank(df: DataFrame, key: str | Sequence[str], seed: int, name: str) -> DataFrame:
    """Number rows 1..n in seeded order; ``key`` must identify rows.

    Ranked inside hash buckets and shifted by the counts of the buckets before, so no task sees more
    than its share.
    """
    placed = df.withColumn("_at", _position(_keys(key), seed)).withColumn(
        "_bucket", F.substring("_at.hash", 1, _PREFIX)
    )
    sizes = placed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inner = F.row_number().over(Window.partitionBy("_bucket").orderBy("_at"))
    # at most 65,536 rows of two small columns
    return (
        placed.withColumn(name, inner)
        .join(F.broadcast(shifts), "_bucket")
        .withColumn(name, F.col(name) + F.col("_shift"))
        .drop("_bucket", "_at", "_shift")
    )
