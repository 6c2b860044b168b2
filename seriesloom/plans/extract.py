"""From landed tag documents to feature rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.bvalues import ge_bvalue
from seriesloom.operators.clean import filter_valid, with_validity
from seriesloom.roles import HEADER_TAGS
from seriesloom.sources.tables import write_table
from seriesloom.sources.tags import (
    VALUE_PROCESSORS,
    flatten_tags_archive,
    flatten_tags_web,
    process_values,
    with_final_bvalue,
)

# Fixed value: the tag that tells image objects from segmentations.
SOP_CLASS_TAG = {"sop_class": "0008,0016"}

# GE lists several numbers, the first of which holds the b-value
EXTRACTION_PROCESSORS = {
    **VALUE_PROCESSORS,
    "diffusion_bvalue_ge": lambda value: ge_bvalue(F.split_part(value, F.lit(" "), F.lit(1))),
}


def extract_features(documents: DataFrame, json: str = "tags", form: str = "web", keep: tuple[str, ...] = ()) -> DataFrame:
    """Valid, non-segmentation instance rows with every header column and the final b-value."""
    flatten = {"web": flatten_tags_web, "archive": flatten_tags_archive}[form]
    rows = flatten(documents, json, {**HEADER_TAGS, **SOP_CLASS_TAG}, keep)
    rows = rows.replace("-", None, subset=["sop_class"])
    return filter_valid(with_validity(with_final_bvalue(process_values(rows, EXTRACTION_PROCESSORS)))).drop("sop_class")


def write_features(features: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Valid, non-segmentation rows as parquet."""
    write_table(filter_valid(features), path, mode)
