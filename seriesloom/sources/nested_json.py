"""Patient → study → series → {feature: [values]} documents, and study → group maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesloom.operators.clean import null_safe_join
from seriesloom.roles import MISSING
from seriesloom.session import materialise

KEYS = ("patient_id", "study_uid", "series_uid")
PLACE = "#at"  # beside the features: the places of a document's rows in their series, a list like any other
_DOCUMENT = "map<string,map<string,map<string,map<string,string>>>>"


def scan_nested_json(
    spark: SparkSession,
    path: str,
    features: Sequence[str] | None = None,
    whole_file: bool = False,
    position: str | None = None,
) -> DataFrame:
    """Instance rows of the documents at ``path``.

    One document per line, or with ``whole_file`` one per file. Files of one document each may be of
    any number, but each must fit a task.
    """
    return explode_documents(spark.read.text(path, wholetext=whole_file), "value", features, position)


def explode_documents(
    df: DataFrame,
    json: str | Column,
    features: Sequence[str] | None = None,
    position: str | None = None,
    unreadable: str = "error",
) -> DataFrame:
    """Documents → one row per instance; the n-th row takes the n-th value of every feature.

    Shorter lists end in NULL; a scalar holds for every row of its series, and a series of scalars only is
    one row. Blank text is no document. Text that is no such document is an error, or with
    ``unreadable="drop"`` left out (``rejected_documents`` has it then). Without ``features`` the names
    are first gathered with one pass over the documents. ``position`` names a column for a row's place in
    its series over all documents of the series (see ``to_documents``).
    """
    if unreadable not in ("error", "drop"):
        raise ValueError(f"unreadable must be 'error' or 'drop', not {unreadable!r}")
    text = F.col(json) if isinstance(json, str) else json
    document = F.from_json(text, _DOCUMENT)
    if unreadable == "error":
        message = F.concat(F.lit("not a nested document of one line or file: "), F.substring(text, 1, 200))
        document = F.when(_unreadable(text), F.raise_error(message).cast(_DOCUMENT)).otherwise(document)
    series = (
        df.select(F.explode(document).alias("patient_id", "studies"))
        .select("patient_id", F.explode("studies").alias("study_uid", "series"))
        .select("patient_id", "study_uid", F.explode("series").alias("series_uid", "cells"))
    )
    if features is None:
        names = series.select(F.explode(F.map_keys("cells")).alias("name")).distinct()
        features = sorted(row.name for row in names.collect())
    features = [f for f in features if f not in (*KEYS, PLACE)]
    raw = {f: F.element_at("cells", f) for f in features}
    lists = {
        f: F.when(F.startswith(value, F.lit("[")), F.from_json(value, "array<string>"))
        for f, value in raw.items()
    }
    parsed = series.select(
        *KEYS,
        F.from_json(F.element_at("cells", PLACE), "array<bigint>").alias(PLACE),
        *[F.struct(lists[f].alias("list"), raw[f].alias("text")).alias(f"_{f}") for f in features],
    )
    longest = F.greatest(*[F.coalesce(F.size(f"_{f}.list"), F.lit(0)) for f in features], F.lit(0))
    no_list = F.coalesce(*[F.col(f"_{f}.list") for f in features]).isNull() if features else F.lit(False)
    no_text = F.coalesce(*[F.col(f"_{f}.text") for f in features]).isNull() if features else F.lit(True)
    count = F.when(no_list & ~no_text, 1).otherwise(longest)
    counted = parsed.withColumn("#n", count).filter(F.col("#n") > 0)
    rows = counted.withColumn("#row", F.explode(F.sequence(F.lit(0), F.col("#n") - 1)))

    def value_of(feature: str) -> Column:
        cell = F.col(f"_{feature}")
        return F.when(cell["list"].isNotNull(), F.get(cell["list"], F.col("#row"))).otherwise(cell["text"])

    place = [] if position is None else [F.coalesce(F.get(PLACE, F.col("#row")), F.col("#row").cast("long")).alias(position)]
    return rows.select(*KEYS, *[value_of(f).alias(f) for f in features], *place)


def _unreadable(text: Column) -> Column:
    return F.from_json(text, _DOCUMENT).isNull() & (F.trim(text) != "")


def rejected_documents(df: DataFrame, json: str, keep: Sequence[str] = ()) -> DataFrame:
    """(keep…, text, reason) of the rows that hold no document."""
    reason = F.when(F.trim(json).startswith("{"), "not patient, study, series and features").otherwise("not an object")
    return df.where(_unreadable(F.col(json))).select(*keep, F.col(json).alias("text"), reason.alias("reason"))


def to_documents(
    df: DataFrame,
    features: Sequence[str],
    order: str,
    keys: Sequence[str] = KEYS,
    instances_per_document: int = 10_000,
) -> DataFrame:
    """Rows → (document) JSON, the rows of a series in ``order``.

    A series of n rows is ceil(n / ``instances_per_document``) documents, so that none has to fit one task.
    Every document holds lists only, one per feature and one, ``#at``, with the places of its rows in the
    series from 0. A reader that appends the lists of a series' documents, whatever their order, thus has
    the whole series with every value beside its place; ``scan_nested_json`` gives the place on demand.
    NULL is written as JSON null, a NULL key as the missing mark.
    """
    # a series lies over neighbouring ranges; written, as a second run would sample other ranges
    ranged = only_columns(df, [*keys, *features, order]).repartitionByRange(*keys, order).withColumn("_range", F.spark_partition_id())
    ranged = materialise(ranged, "ranged")
    counts = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_in_range"))
    series = W.partitionBy(*keys)
    before = F.sum("_in_range").over(series.orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    sizes = counts.select(
        *keys, "_range", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_in_range").over(series).alias("_n")
    )
    rank = F.row_number().over(W.partitionBy(*keys, "_range").orderBy(order)) - 1
    placed = null_safe_join(ranged.withColumn("_rank", rank), sizes, [*keys, "_range"])
    placed = placed.withColumn("_rank", F.col("_rank") + F.col("_before"))
    placed = placed.withColumn("_chunk", F.expr(f"_rank * cast(ceil(_n / {instances_per_document}) as bigint) div _n"))
    # by document, not by series: a hot series must not end in one task
    placed = placed.repartition(*keys, "_chunk")
    cells = F.struct(F.col("_rank"), *[F.col(f).cast("string").alias(f) for f in features])
    grouped = placed.groupBy(*keys, "_chunk").agg(F.array_sort(F.collect_list(cells)).alias("_rows"))
    # JSON has no null key
    patient, study, series = (F.coalesce(F.col(k).cast("string"), F.lit(MISSING)) for k in keys)
    # places are numbers and features are text, so the cells are a struct
    content = F.struct(F.col("_rows")["_rank"].alias(PLACE), *[F.col("_rows")[f].alias(f) for f in features])
    nested = F.create_map(patient, F.create_map(study, F.create_map(series, content)))
    return grouped.select(F.to_json(nested, {"ignoreNullFields": "false"}).alias("document"))


def only_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` without the columns that none of ``names`` (columns or fields of them) stands for."""
    if any("`" in name for name in names):
        return df
    wanted = {part for name in names for part in (name.lower(), name.split(".")[0].lower())}
    return df.drop(*[c for c in df.columns if c.lower() not in wanted])


def write_documents(documents: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines."""
    documents.select("document").write.mode(mode).text(path)


def explode_group_map(df: DataFrame, json: str | Column, key: str = "study_uid", group: str = "group") -> DataFrame:
    """JSON objects ``{study: group}`` → rows."""
    return df.select(F.explode(F.from_json(json, "map<string,string>")).alias(key, group))


def scan_group_map(spark: SparkSession, path: str, whole_file: bool = True) -> DataFrame:
    """Group map of one JSON object per file, or per line."""
    return explode_group_map(spark.read.text(path, wholetext=whole_file), "value")
