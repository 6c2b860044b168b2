"""Batch prediction: instance rows → series rows → votes → rules."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.operators.clean import rename_columns, sanitize, sort_predictions
from seriesloom.operators.models import FoldModel, score_ensemble
from seriesloom.operators.rules import apply_rule, override
from seriesloom.operators.summarise import summarise
from seriesloom.roles import SERIES_KEYS, STANDARD, STUDY_KEYS
from seriesloom.sources.tables import read_any

LEVELS = {"series": SERIES_KEYS, "study": STUDY_KEYS, "instance": None}


def features_of(
    instances: DataFrame,
    reduce: str = "series",
    mapping: Mapping[str, str] | Iterable[str] | None = None,
    mode: str = "exact",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Renamed, folded and sanitised feature rows at series, study or instance level.

    ``columns`` are those to fold, all if None.
    """
    if mapping is not None:
        instances = rename_columns(instances, mapping)
    keys = LEVELS[reduce]
    return sanitize(instances if keys is None else summarise(instances, keys, columns=columns), mode)


def columns_read(models: Sequence[FoldModel], rule: str | None = None, also: Sequence[str] = ()) -> list[str]:
    """The columns that models and rule read: the models' roles, for a rule all standard text columns, and ``also``."""
    roles = [m.plan.roles for m in models] + ([STANDARD] if rule is not None else [])
    return list(dict.fromkeys(c for r in roles for c in (*r.text, *r.number_token, *r.numeric, *r.defaults))) + list(also)


def predict(
    instances: DataFrame,
    models: Sequence[FoldModel],
    rule: str | None = None,
    reduce: str = "series",
    mapping: Mapping[str, str] | Iterable[str] | None = None,
    mode: str = "exact",
    also: Sequence[str] = (),
) -> DataFrame:
    """Prediction table of an instance table. Models see data cleaned in the mode they were trained with.

    Folding leaves out columns that neither models nor rule read; ``also`` names more, for a rule of one's own.
    """
    columns = columns_read(models, rule, also)
    return score_ensemble(models, features_of(instances, reduce, mapping, mode, columns), rule)


def predict_paths(
    spark: SparkSession,
    paths: str | Sequence[str],
    models: Sequence[FoldModel],
    rule: str | None = None,
    reduce: str = "series",
    mapping: Mapping[str, str] | Iterable[str] | None = None,
    mode: str = "exact",
    multiline: bool = False,
    whole_file: bool = False,
) -> DataFrame:
    """As ``predict``, from files, sorted by study and series. The last two parameters are ``read_any``'s."""
    table = read_any(spark, paths, LEVELS[reduce], mapping, multiline=multiline, whole_file=whole_file)
    features = sanitize(table, mode)
    return sort_predictions(score_ensemble(models, features, rule))


def override_votes(
    instances: DataFrame, votes: DataFrame, rule: str = "prostate_mpmri", mode: str = "exact"
) -> DataFrame:
    """Prediction without models at hand: given series votes, fold the instances and apply the rule.

    ``votes`` holds study_uid, series_uid and prediction. The rule flags leave the aggregation hashed
    by series, and the join reuses that partitioning where Spark does not broadcast the votes.
    """
    series = features_of(instances, "series", mode=mode)
    flags = apply_rule(series, rule, SERIES_KEYS)
    labels = {c: F.col(c) for c in flags.columns if c not in SERIES_KEYS}
    joined = flags.join(votes.select("study_uid", "series_uid", "prediction"), ["study_uid", "series_uid"])
    final = override(F.col("prediction"), labels).alias("prediction_heuristics")
    return joined.select("patient_id", "study_uid", "series_uid", "prediction", final)
