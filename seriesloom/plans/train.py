"""Training jobs and learning curves."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.operators.clean import clean_target, drop_role_columns, sanitize
from seriesloom.operators.models import FoldModel, TrainSpec, cv_train, score_holdout
from seriesloom.operators.split import group_kfold, leave_one_group_out, subset_rows
from seriesloom.session import materialise
from seriesloom.sources.tables import read_any


def training_table(
    df: DataFrame,
    target: str = "class",
    task: str = "classification",
    keep: Sequence[str] = ("study_uid", "series_uid"),
    mode: str = "exact",
) -> DataFrame:
    """Clean target, sanitised features, no columns a model may not see but ids and target.

    The input must already hold one row per series.
    """
    clean = sanitize(clean_target(df, target, task), mode)
    return drop_role_columns(clean, target, keep=[*keep, target])


def load_training_table(
    spark: SparkSession,
    paths: str | Sequence[str],
    target: str = "class",
    task: str = "classification",
    keep: Sequence[str] = ("study_uid", "series_uid"),
    mode: str = "exact",
) -> DataFrame:
    """As ``training_table``, from files."""
    return training_table(read_any(spark, paths, keys=None), target, task, keep, mode)


def train(
    df: DataFrame,
    spec: TrainSpec,
    n_folds: int = 5,
    groups: DataFrame | None = None,
    subset: float | None = None,
    holdout: DataFrame | None = None,
) -> tuple[list[FoldModel], DataFrame]:
    """Fold models and their long prediction table (splits ``cv`` and, with a holdout, ``test``).

    Folds are drawn over distinct studies, or given by a study → group map.
    """
    return _train(materialise(df, "training"), spec, n_folds, groups, subset, holdout)


def _train(df, spec, n_folds, groups, subset, holdout) -> tuple[list[FoldModel], DataFrame]:
    """``df`` is read several times, so it should be a stored table."""
    if subset is not None:
        df = subset_rows(df, spec.row_key, subset, spec.seed)
    if groups is None:
        folded, folds = group_kfold(df, "study_uid", n_folds, spec.seed), list(range(n_folds))
    else:
        folded, folds = leave_one_group_out(df, groups), None
    models, predictions = cv_train(folded, spec, "fold", folds)
    predictions = predictions.withColumn("split", F.lit("cv"))
    if holdout is not None:
        test = score_holdout(models, holdout, spec).withColumn("split", F.lit("test"))
        predictions = predictions.unionByName(test)
    return models, predictions


def learning_curve(
    df: DataFrame,
    spec: TrainSpec,
    fractions: Sequence[float],
    models: Sequence[str] = ("rf",),
    exclusions: Sequence[Sequence[str]] = ((),),
    n_folds: int = 5,
    holdout: DataFrame | None = None,
    params: Mapping[str, Mapping[str, object]] | None = None,
) -> DataFrame:
    """Predictions for every fraction of the rows, model and column exclusion, ready for ``metrics_long``.

    ``params`` holds parameters by model name; those of ``spec`` are for its own model only.
    """
    params = {spec.model: dict(spec.params), **(params or {})}
    df = materialise(df, "training")
    holdout = None if holdout is None else materialise(holdout, "holdout")
    parts = []
    for fraction in fractions:
        for model in models:
            for exclusion in exclusions:
                current = replace(
                    spec,
                    model=model,
                    params=tuple(params.get(model, {}).items()),
                    roles=spec.roles.restricted(exclude=exclusion),
                )
                subset = None if fraction == 1 else fraction
                _, rows = _train(df, current, n_folds, None, subset, holdout)
                rows = rows.withColumns(
                    {
                        "model": F.lit(model),
                        "exclusion": F.lit(":".join(exclusion) or "standard"),
                        "fraction": F.lit(float(fraction)),
                        "row_id": F.concat_ws("|", *spec.row_key),
                    }
                ).drop(*spec.row_key)
                parts.append(rows)
    return reduce(DataFrame.unionByName, parts)
