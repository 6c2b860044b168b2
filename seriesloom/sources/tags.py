"""Tag documents of image archives, flattened to one column per known tag."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.bvalues import first_given
from seriesloom.functions.text import join_backslashes, join_list, strip_datetimes
from seriesloom.operators.summarise import count_instances
from seriesloom.roles import HEADER_TAGS, MISSING


def flatten_tags_web(
    df: DataFrame,
    json: str = "tags",
    tags: Mapping[str, str] = HEADER_TAGS,
    keep: tuple[str, ...] = (),
    need: Sequence[str] = (),
    fault: str | None = None,
) -> DataFrame:
    """``{"00180081": {"vr": …, "Value": […]}}`` → one text column per tag, absent tags marked.

    Only the listed tags are parsed out of the document. Rows without a document, text that is none and
    documents that lack a column of ``need`` are left out, see ``rejected_tags``; with ``fault`` they stay,
    and the column of that name tells what is wrong (NULL if nothing is).
    """
    keys = {name: tag.replace(",", "") for name, tag in tags.items()}
    schema = ", ".join(f"`{key}` struct<Value: array<string>>" for key in keys.values())
    read = F.from_json(json, f"{schema}, `{_UNREAD}` string", {"columnNameOfCorruptRecord": _UNREAD})
    parsed = df.select(*keep, F.col(json).isNull().alias("_absent"), read.alias("_tags"))
    flat = {n: join_list(F.col("_tags")[key]["Value"]) for n, key in keys.items()}
    # a document with one odd value still has its others
    nothing = F.coalesce(*[F.col("_tags")[key] for key in keys.values()]).isNull()
    unread = F.col("_tags").isNull() | (F.col("_tags")[_UNREAD].isNotNull() & nothing)
    return _judged(parsed, unread, flat, keep, need, fault)


def flatten_tags_archive(
    df: DataFrame,
    json: str = "tags",
    tags: Mapping[str, str] = HEADER_TAGS,
    keep: tuple[str, ...] = (),
    need: Sequence[str] = (),
    fault: str | None = None,
) -> DataFrame:
    """``{"0018,0081": {"Value": "1\\\\2"}}`` → one text column per tag; hex digits in either case.

    ``need`` and ``fault`` are those of ``flatten_tags_web``.
    """
    read = F.from_json(json, "map<string,struct<Value:string>>").alias("_tags")
    parsed = df.select(*keep, F.col(json).isNull().alias("_absent"), read)

    def cell(tag: str) -> Column:
        spellings = dict.fromkeys((tag.upper(), tag.lower()))
        return F.coalesce(*[F.element_at("_tags", key)["Value"] for key in spellings])

    flat = {n: join_backslashes(cell(tag)) for n, tag in tags.items()}
    return _judged(parsed, F.col("_tags").isNull(), flat, keep, need, fault)


_UNREAD = "#unread"
# what a row needs to have a place in a study
IDENTITY = ("study_uid", "series_uid")


def _judged(
    parsed: DataFrame, unread: Column, flat: Mapping[str, Column], keep: tuple[str, ...], need: Sequence[str], fault: str | None
) -> DataFrame:
    """The flattened rows of the documents that will do, or all with what is wrong."""
    reason = F.when(F.col("_absent"), "no document").when(unread, "not a tag document")
    for name in need:
        reason = reason.when(F.trim(flat[name]).isin("", MISSING), f"no {name}")
    rows = parsed.select(*keep, *[value.alias(n) for n, value in flat.items()], reason.alias(fault or _UNREAD))
    return rows if fault is not None else rows.where(F.col(_UNREAD).isNull()).drop(_UNREAD)


def rejected_tags(
    df: DataFrame, json: str = "tags", form: str = "web", keep: tuple[str, ...] = (), need: Sequence[str] = IDENTITY
) -> DataFrame:
    """(keep…, reason) of the documents that the flattening leaves out if it has that ``need``."""
    flatten = {"web": flatten_tags_web, "archive": flatten_tags_archive}[form]
    return flatten(df, json, HEADER_TAGS, keep, need, "reason").where(F.col("reason").isNotNull()).select(*keep, "reason")


# Value processors by column, applied after flattening; callers may add their own.
VALUE_PROCESSORS = {"series_description": strip_datetimes}


def process_values(df: DataFrame, processors: Mapping = VALUE_PROCESSORS) -> DataFrame:
    """Apply ``{column: Column → Column}`` to the columns a table has."""
    present = {name: fn(F.col(name)) for name, fn in processors.items() if name in df.columns}
    return df.withColumns(present) if present else df


def with_final_bvalue(df: DataFrame) -> DataFrame:
    """``diffusion_bvalue_final``: the first b-value column that is given."""
    columns = ["diffusion_bvalue", "diffusion_bvalue_ge", "diffusion_bvalue_siemens"]
    return df.withColumn("diffusion_bvalue_final", first_given(columns))


def name_study(instances: DataFrame) -> DataFrame:
    """Patient id from the study, and value processors applied."""
    return process_values(instances.withColumn("patient_id", F.col("study_uid")))


def assemble_study(instances: DataFrame) -> DataFrame:
    """Flattened instances of whole studies: patient id from the study, series sizes, clean description."""
    return count_instances(name_study(instances), ("study_uid", "series_uid"), "number_of_images")
