"""From landed tag documents to nested metadata documents: every series at its largest b-value."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.bvalues import bytes_bvalue
from seriesloom.operators.clean import filter_max_bvalue
from seriesloom.plans.extract import extract_features
from seriesloom.roles import HEADER_TAGS
from seriesloom.session import materialise
from seriesloom.sources.nested_json import KEYS, only_columns, to_documents

# the b-value column that holds a vendor's own value, by what its manufacturer's name contains
VENDORS = {"siemens": "diffusion_bvalue_siemens", "ge med": "diffusion_bvalue_ge"}


def metadata_rows(
    documents: DataFrame,
    order: str,
    json: str = "tags",
    form: str = "web",
    patient: str | Column = "study_uid",
    raw: Mapping[str, str] | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Valid image rows of the documents, each series reduced to its largest b-value (see ``filter_max_bvalue``).

    ``order`` tells a series' first row, whose maker decides on the vendor's column. ``patient`` is a column,
    or an expression over ``order`` and ``keep`` (a path, say, of which a pattern is the patient). ``raw`` maps
    a b-value column to a binary column of ``documents`` with the tag's bytes, which are read in place of the
    text where they hold a credible number.
    """
    raw = raw or {}
    rows = extract_features(documents, json, form, keep=tuple(dict.fromkeys((order, *keep, *raw.values()))))
    rows = rows.withColumns({name: F.coalesce(bytes_bvalue(source, F.col(name)), F.col(name)) for name, source in raw.items()})
    rows = rows.drop(*[c for c in raw.values() if c not in keep])
    chosen = F.col(patient) if isinstance(patient, str) else patient
    return filter_max_bvalue(rows.withColumn("patient_id", chosen), ("study_uid", "series_uid"), order, vendors=VENDORS)


def metadata_documents(
    documents: DataFrame,
    order: str,
    json: str = "tags",
    form: str = "web",
    patient: str | Column = "study_uid",
    raw: Mapping[str, str] | None = None,
    features: Sequence[str] | None = None,
    instances_per_document: int = 10_000,
) -> DataFrame:
    """(document): patient → study → series → {feature: [values]} of ``metadata_rows``, the rows by ``order``.

    ``features`` are all header columns, the final b-value and ``order`` unless they are named.
    """
    rows = metadata_rows(documents, order, json, form, patient, raw)
    if features is None:
        features = [*[c for c in HEADER_TAGS if c not in KEYS], "diffusion_bvalue_final", order]
    # written, as the ranges' sample would parse all documents once more
    rows = materialise(only_columns(rows, [*KEYS, *features, order]), "metadata_rows")
    return to_documents(rows, features, order, instances_per_document=instances_per_document)
