"""Rules that override predictions, as Column expressions in a registry."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.bvalues import first_given, max_token_number
from seriesloom.functions.text import has_tokens

Rule = Callable[[DataFrame], dict[str, Column]]

_REGISTRY: dict[str, Rule] = {}


def register_rule(name: str) -> Callable[[Rule], Rule]:
    """Register a function ``table → {class: boolean column}``; its order is the priority."""

    def add(rule: Rule) -> Rule:
        _REGISTRY[name] = rule
        return rule

    return add


def rule_names() -> list[str]:
    return sorted(_REGISTRY)


def find_rule(name: str) -> Rule:
    if name not in _REGISTRY:
        raise ValueError(f"unknown rule {name!r}, known are {rule_names()}")
    return _REGISTRY[name]


def resolved_bvalue(df: DataFrame) -> Column:
    """b-value cell: the base column, else GE's, else Siemens'."""
    proxies = [c for c in ("diffusion_bvalue_ge", "diffusion_bvalue_siemens") if c in df.columns]
    return first_given(["diffusion_bvalue", *proxies])


@register_rule("prostate_mpmri")
def sequence_type_rule(df: DataFrame) -> dict[str, Column]:
    """DWI, T2W and ADC from description, image type and b-value. Takes text as given."""
    description = F.coalesce(F.col("series_description"), F.lit(""))
    image_type = F.coalesce(F.col("image_type"), F.lit(""))
    weighted = max_token_number(resolved_bvalue(df)) > 0
    return {
        "DWI": weighted & has_tokens(description, "~adc") & has_tokens(image_type, "~adc"),
        "T2W": has_tokens(description, ["t2", "~cor", "~sag"]),
        "ADC": image_type.contains("adc") | has_tokens(description, "adc", separator=" "),
    }


def apply_rule(
    df: DataFrame, name: str = "prostate_mpmri", keys: Sequence[str] = ("study_uid", "series_uid")
) -> DataFrame:
    """Keys plus one boolean column per class of the named rule."""
    columns = find_rule(name)(df)
    return df.select(*keys, *[value.alias(label) for label, value in columns.items()])


def override(prediction: Column, rules: dict[str, Column], last_wins: bool = False) -> Column:
    """The first class whose rule holds (or the last one), else the prediction."""
    ordered = list(rules.items())
    if last_wins:
        ordered.reverse()
    chosen = None
    for label, holds in ordered:
        chosen = F.when(holds, F.lit(label)) if chosen is None else chosen.when(holds, F.lit(label))
    return prediction if chosen is None else chosen.otherwise(prediction)


def apply_overrides(
    predictions: DataFrame,
    flags: DataFrame,
    keys: Sequence[str] = ("study_uid", "series_uid"),
    last_wins: bool = False,
) -> DataFrame:
    """Join predictions with rule flags and let a holding rule replace ``prediction_heuristics``.

    Flags are one row per series, so no row is repeated by the join.
    """
    labels = [c for c in flags.columns if c not in keys]
    chosen = override(F.col("prediction_heuristics"), {c: F.col(c) for c in labels}, last_wins)
    joined = predictions.join(flags, list(keys)).withColumn("prediction_heuristics", chosen)
    return joined.select("patient_id", "study_uid", "series_uid", "prediction", "prediction_heuristics")
