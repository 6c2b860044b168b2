"""Scoring studies whose tag documents have landed in a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from seriesloom.operators.clean import filter_regex, union_diagonal
from seriesloom.operators.models import FoldModel, score_ensemble
from seriesloom.operators.summarise import summarise
from seriesloom.sources.tags import IDENTITY, flatten_tags_archive, flatten_tags_web, name_study


@dataclass(frozen=True)
class ModelConfig:
    """How one served model is used."""

    models: tuple[FoldModel, ...]
    rule: str | None = None
    filters: Mapping[str, str | Sequence[str]] = field(default_factory=dict)


def study_features(
    documents: Sequence[DataFrame],
    form: str = "web",
    json: str = "tags",
    filters: Mapping[str, str | Sequence[str]] | None = None,
) -> DataFrame:
    """Series rows of whole studies, from one or more document tables.

    Documents without study or series are left out. The series sizes come out of the folding itself, so instances are shuffled once and never joined.
    """
    flatten = {"web": flatten_tags_web, "archive": flatten_tags_archive}[form]
    instances = union_diagonal([name_study(flatten(d, json, need=IDENTITY)) for d in documents])
    return filter_regex(summarise(instances), filters)


def predict_studies(
    documents: Sequence[DataFrame], config: ModelConfig, form: str = "web", json: str = "tags"
) -> DataFrame:
    """Prediction table of the studies in the document tables. Text is used as it is, not sanitised."""
    return score_ensemble(config.models, study_features(documents, form, json, config.filters), config.rule)
