"""Renaming, cleaning and row filters."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions import let
from seriesloom.functions.numbers import parse_number
from seriesloom.roles import MISSING, SEGMENTATION_SOP_CLASS, STANDARD, Roles

# Punctuation that separates words in header text.
PUNCTUATION = "|-;,.()_:"
# Cells equal to one of these escaped marks are blank.
ESCAPED_MARKS = (r"\|", r"\-", ";", ",", r"\.", r"\(", r"\)", "_", ":")


def underscore_names(df: DataFrame) -> DataFrame:
    """Spaces in column names become underscores."""
    return df.toDF(*[name.replace(" ", "_") for name in df.columns])


def rename_columns(df: DataFrame, mapping: Mapping[str, str] | Iterable[str]) -> DataFrame:
    """Rename by mapping or by ``old:new`` pairs."""
    if not isinstance(mapping, Mapping):
        mapping = dict(pair.split(":")[:2] for pair in mapping)
    unknown = [old for old in mapping if old not in df.columns]
    if unknown:
        raise ValueError(f"columns to rename are absent: {unknown}")
    return df.withColumnsRenamed(dict(mapping))


def role_project(
    df: DataFrame,
    roles: Roles = STANDARD,
    include: Iterable[str] | None = None,
    exclude: Iterable[str] | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Feature columns left after the drop list and include/exclude lists, preceded by ``keep``."""
    chosen = roles.restricted(include, exclude)
    features = {*chosen.text, *chosen.number_token, *chosen.numeric} - set(roles.drop)
    return df.select(*keep, *[c for c in df.columns if c in features and c not in keep])


def drop_role_columns(df: DataFrame, target: str, roles: Roles = STANDARD, keep: Sequence[str] = ()) -> DataFrame:
    """Drop the columns no model may see, the target among them."""
    return df.drop(*[c for c in {*roles.drop, target} if c not in keep])


def sanitize(df: DataFrame, mode: str = "exact", roles: Roles = STANDARD) -> DataFrame:
    """Clean text and number-token columns: punctuation, outer spaces, empty → default, lower case.

    ``mode="exact"`` blanks cells that *equal* one of the escaped marks and leaves all other text
    whole. ``mode="substring"`` turns every punctuation mark inside the text into a space, which also
    splits decimals. Models must score data cleaned in the mode they were trained with.
    """
    if mode not in ("exact", "substring"):
        raise ValueError(f"mode must be 'exact' or 'substring', not {mode!r}")
    cleaned = {}
    for name in dict.fromkeys((*roles.text, *roles.number_token, *roles.defaults)):
        if name not in df.columns:
            continue
        value = F.col(name)
        if name in roles.text or name in roles.number_token:
            if mode == "substring":
                value = F.translate(value, PUNCTUATION, " " * len(PUNCTUATION))
            else:
                value = F.when(value.isin(*ESCAPED_MARKS), F.lit(" ")).otherwise(value)
            value = F.trim(value)
        if name in roles.defaults:
            value = F.when(value == "", F.lit(roles.defaults[name])).otherwise(value)
        cleaned[name] = F.lower(value)
    return df.withColumns(cleaned) if cleaned else df


def filter_regex(df: DataFrame, filters: Mapping[str, str | Sequence[str]] | None) -> DataFrame:
    """Rows whose every named column contains its pattern, ignoring case; a list is an alternation."""
    if not filters:
        return df
    tests = []
    for name, pattern in filters.items():
        alternatives = [pattern] if isinstance(pattern, str) else pattern
        tests.append(F.lower(F.col(name)).rlike("|".join(p.lower() for p in alternatives)))
    return df.filter(reduce(Column.__and__, tests))


def filter_tags_exact(df: DataFrame, filters: Mapping[str, str | Sequence[str]] | None) -> DataFrame:
    """Rows whose every named column equals its value or lies in its list; an absent value fails."""
    if not filters:
        return df
    tests = []
    for name, wanted in filters.items():
        if name not in df.columns:
            tests.append(F.lit(False))
            continue
        test = F.col(name) == wanted if isinstance(wanted, str) else F.col(name).isin(*wanted)
        tests.append(F.coalesce(test, F.lit(False)))
    return df.filter(reduce(Column.__and__, tests))


def with_validity(df: DataFrame, sop_class: str = "sop_class", readable: str | None = None) -> DataFrame:
    """Flags ``valid`` and ``seg``; a missing SOP class is invalid and no segmentation."""
    sop = F.col(sop_class)
    valid = sop.isNotNull()
    if readable is not None:
        valid = valid & F.coalesce(F.col(readable), F.lit(False))
    seg = F.coalesce(sop == SEGMENTATION_SOP_CLASS, F.lit(False))
    return df.withColumns({"valid": valid, "seg": seg})


def filter_valid(df: DataFrame) -> DataFrame:
    """Readable rows that are no segmentation objects."""
    return df.filter(F.col("valid") & ~F.col("seg"))


def drop_nan_rows(df: DataFrame, columns: Sequence[str], allowed: int = 1) -> DataFrame:
    """Drop rows with more than ``allowed`` NULL or NaN values in ``columns``."""
    return df.dropna(thresh=len(columns) - allowed, subset=list(columns))


def clean_target(df: DataFrame, target: str = "class", task: str = "classification") -> DataFrame:
    """Lower-case class labels, or numeric targets limited to finite numbers."""
    if task == "classification":
        return df.withColumn(target, F.lower(F.col(target)))
    number = F.col(target).try_cast("double")
    out = df.withColumn(target, number)
    value = F.col(target)
    return out.filter(value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")))


def filter_by_ids(df: DataFrame, ids: DataFrame, on: str, keep: bool = True) -> DataFrame:
    """Rows whose id is in ``ids``, or with ``keep=False`` those whose id is not."""
    return df.join(ids.select(on), on, "left_semi" if keep else "left_anti")


def filter_max_bvalue(
    df: DataFrame,
    keys: Sequence[str] = ("study_uid", "series_uid"),
    order: str | None = None,
    base: str = "diffusion_bvalue",
    vendors: Mapping[str, str] | None = None,
    manufacturer: str = "manufacturer",
) -> DataFrame:
    """Keep, per series, the rows at its largest b-value; then likewise for the vendor's own column.

    A series with an unparsable b-value is left whole. The vendor is read off the first remaining row
    by ``order`` (without one: the smallest manufacturer name). A series is reduced to its distinct
    combinations of b-values before any shuffle; they meet in one array, in which all passes run, and
    the rows are filtered once by what is left. So the table is read twice, whatever the number of vendors.
    """
    vendors = vendors or {"siemens": "diffusion_bvalue_siemens", "ge med": "diffusion_bvalue_ge"}
    values = [base, *vendors.values()]
    parts = [*keys, *values, manufacturer]
    first = F.min(F.col(order) if order else F.col(manufacturer)).alias("_first")
    cells = [F.col(c).alias(f"value{i}") for i, c in enumerate(values)]
    combos = F.collect_list(F.struct(*cells, F.col(manufacturer).alias("maker"), F.col("_first").alias("first")))
    left = combos.alias("_left")
    per_series = df.groupBy(*parts).agg(first).groupBy(*keys).agg(left)
    for i, vendor in enumerate([None, *vendors]):
        per_series = per_series.withColumn("_left", _at_largest(F.col("_left"), f"value{i}", vendor))
    kept = per_series.select(*keys, F.explode("_left").alias("_kept"))
    kept = kept.select(*keys, *[F.col(f"_kept.value{i}").alias(c) for i, c in enumerate(values)], F.col("_kept.maker").alias(manufacturer))
    return null_safe_join(df, kept, parts, "left_semi")


def _at_largest(combos: Column, value: str, vendor: str | None) -> Column:
    """The combinations at the largest number of ``value``; all of them if one is unreadable or another vendor's."""

    def number(combo: Column) -> Column:
        return F.when(combo[value] == MISSING, F.lit(-1.0)).otherwise(parse_number(combo[value]))

    numbered = F.transform(combos, lambda c: F.struct(c.alias("combo"), number(c).alias("number")))
    known = F.filter(combos, lambda c: c["first"].isNotNull())
    maker = F.array_min(F.transform(known, lambda c: F.struct(c["first"], c["maker"])))["maker"]
    ours = F.lit(True) if vendor is None else F.coalesce(F.lower(maker).contains(vendor), F.lit(False))
    state = F.struct(
        numbered.alias("numbered"),
        F.array_max(F.transform(numbered, lambda x: x["number"])).alias("top"),
        (ours & ~F.exists(numbered, lambda x: x["number"].isNull())).alias("applies"),
    )

    def chosen(s: Column) -> Column:
        at_top = F.filter(s["numbered"], lambda x: ~s["applies"] | (x["number"] == s["top"]))
        return F.transform(at_top, lambda x: x["combo"])

    return let(state, chosen)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match each other; the right side's keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    match = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, match, how).drop(*[f"_right_{k}" for k in keys])


def feature_variances(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long table (feature, variance, kept) over all rows; NULL and NaN are left out."""
    known = {c: F.when(~F.isnan(F.col(c).try_cast("double")), F.col(c).try_cast("double")) for c in columns}
    wide = df.agg(*[F.var_pop(value).alias(name) for name, value in known.items()])
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("variance")) for c in columns])
    )
    return wide.select(pairs.alias("pair")).select(
        "pair.feature", "pair.variance", F.coalesce(F.col("pair.variance") > 0, F.lit(False)).alias("kept")
    )


def variance_filter(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop those of ``columns`` that never vary. Reads the data once to learn which."""
    flat = [row.feature for row in feature_variances(df, columns).collect() if not row.kept]
    return df.drop(*flat)


def sort_predictions(df: DataFrame, keys: Sequence[str] = ("study_uid", "series_uid")) -> DataFrame:
    """Globally sorted by study and series (a range-partitioned sort)."""
    return df.orderBy(*keys)


def union_vertical(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack tables of one and the same schema; any difference is an error."""
    expected = [(f.name, f.dataType) for f in frames[0].schema.fields]
    for frame in frames[1:]:
        found = [(f.name, f.dataType) for f in frame.schema.fields]
        if found != expected:
            raise ValueError(f"schemas differ: {expected} and {found}")
    return reduce(DataFrame.union, frames)


def union_diagonal(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack tables by column name; a column a table lacks becomes NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def class_order(df: DataFrame, target: str = "class") -> DataFrame:
    """(class, class_index): distinct labels numbered from 0 in sorted order."""
    labels = df.filter(F.col(target).isNotNull()).select(target).distinct()
    ordered = labels.agg(F.sort_array(F.collect_set(target)).alias("labels"))
    return ordered.select(F.posexplode("labels").alias("class_index", target)).select(target, "class_index")
