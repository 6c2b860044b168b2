"""Confusion, precision and recall, explained variance, AUC and feature importance tables."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.operators.joins import label_grid


def confusion_counts(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by…, y_true, y_pred, n): the one pass over the rows that all class metrics share."""
    return predictions.groupBy(*by, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(
    predictions: DataFrame, labels: Mapping[str, str] | Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """(by…, true, pred, n) for every pair of the label list, zero where no row falls.

    Rows with a label outside the list are left out.
    """
    display = dict(labels) if isinstance(labels, Mapping) else {v: v for v in labels}
    counts = confusion_counts(predictions, by)
    return _fill_grid(counts, display, by)


def _fill_grid(counts: DataFrame, display: Mapping, by: Sequence[str]) -> DataFrame:
    """One row per group with its counts as a map, laid out over the fixed label grid."""
    known = F.col("y_true").isin(*display) & F.col("y_pred").isin(*display)
    # at most len(labels)² entries per group; groups of only unknown labels still get their zeros
    pair = F.struct(F.col("y_true").cast("string").alias("t"), F.col("y_pred").cast("string").alias("p"))
    cell = F.when(known, F.struct(pair.alias("pair"), F.col("n").alias("n")))
    maps = counts.groupBy(*by).agg(F.map_from_entries(F.collect_list(cell)).alias("cells"))
    grid = F.array(
        *[
            F.struct(
                F.struct(F.lit(str(t)).alias("t"), F.lit(str(p)).alias("p")).alias("pair"),
                F.lit(dt).alias("true"),
                F.lit(dp).alias("pred"),
            )
            for t, dt in display.items()
            for p, dp in display.items()
        ]
    )
    return maps.select(*by, "cells", F.explode(grid).alias("g")).select(
        *by, "g.true", "g.pred", F.coalesce(F.element_at("cells", F.col("g.pair")), F.lit(0)).alias("n")
    )


def labelled_grid(predictions: DataFrame, labels: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """The label grid joined with its counts (the ungrouped confusion matrix, as a join)."""
    counts = confusion_counts(predictions)
    grid = label_grid(predictions.sparkSession, labels)
    hit = (F.col("y_true") == F.col("true_value")) & (F.col("y_pred") == F.col("pred_value"))
    return grid.join(counts, hit, "left").select("true", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def classification_report(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by…, class, precision, recall, f1, support): one row per class, ``macro avg`` and ``weighted avg``.

    Undefined values are NULL and left out of the averages.
    """
    return _report(confusion_counts(predictions, by), by)


def _report(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    both = F.explode(
        F.array(
            F.struct(F.col("y_true").cast("string").alias("class"), F.lit(True).alias("real")),
            F.struct(F.col("y_pred").cast("string").alias("class"), F.lit(False).alias("real")),
        )
    ).alias("side")
    hit = F.col("y_true") == F.col("y_pred")
    real = F.col("side.real")

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0)).cast("double")

    per_class = (
        counts.select(*by, "y_true", "y_pred", "n", both)
        .groupBy(*by, F.col("side.class").alias("class"))
        .agg(
            total(real & hit).alias("tp"),
            total(~real).alias("predicted"),
            total(real).alias("support"),
        )
        .select(
            *by,
            "class",
            _ratio(F.col("tp"), F.col("predicted")).alias("precision"),
            _ratio(F.col("tp"), F.col("support")).alias("recall"),
            _ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"),
            "support",
        )
    )
    values = ("precision", "recall", "f1")
    weight = F.col("support")
    averages = per_class.groupBy(*by).agg(
        *[F.avg(v).alias(f"macro_{v}") for v in values],
        *[
            F.try_divide(F.sum(F.col(v) * weight), F.sum(F.when(F.col(v).isNotNull(), weight))).alias(f"weighted_{v}")
            for v in values
        ],
        F.sum("support").alias("support"),
    )
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(f"{kind} avg").alias("class"),
                    *[F.col(f"{kind}_{v}").alias(v) for v in values],
                    F.col("support"),
                )
                for kind in ("macro", "weighted")
            ]
        )
    ).alias("row")
    return per_class.unionByName(averages.select(*by, rows).select(*by, "row.*"))


def r2_score(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by…, r2) in one pass: squared errors against n times the target's variance."""
    y, p = F.col("y_true").try_cast("double"), F.col("y_pred").try_cast("double")
    sums = predictions.groupBy(*by).agg(
        F.sum((y - p) * (y - p)).alias("error"), (F.var_pop(y) * F.count(y)).alias("spread")
    )
    exact = F.when(F.col("error") == 0, 1.0).otherwise(0.0)
    r2 = F.when(F.col("spread") != 0, 1 - F.col("error") / F.col("spread")).otherwise(exact)
    return sums.select(*by, r2.alias("r2"))


def pairwise_auc(
    scores: DataFrame, labels: Sequence, by: Sequence[str] = (), buckets: int = 256
) -> DataFrame:
    """(by…, cls, other, wins, n_pos, n_neg): how often rows of class ``cls`` outscore rows of ``other``.

    ``scores`` is long: (by…, cls, y_true, score), ``score`` being the score for ``cls``. Ties count one
    half. Rows are first reduced to counts per distinct score; these are ranked inside score ranges
    that each hold about 1/``buckets`` of the data, so one class never has to be sorted by one task.
    Finding the ranges reads the scores once.
    """
    inner = [i / buckets for i in range(1, buckets)]
    points = sorted(set(scores.approxQuantile("score", inner, 1 / (4 * buckets)))) or [0.0]
    ranges = Bucketizer(
        splits=[-math.inf, *points, math.inf], inputCol="score", outputCol="_range", handleInvalid="keep"
    )
    n = [f"_n{i}" for i in range(len(labels))]
    tally = scores.groupBy(*by, "cls", "score").agg(
        *[F.count(F.when(F.col("y_true") == label, 1)).alias(c) for c, label in zip(n, labels)]
    )
    place = ranges.transform(tally)
    positives = F.coalesce(*[F.when(F.col("cls") == label, F.col(c)) for c, label in zip(n, labels)])
    lower = (
        Window.partitionBy(*by, "cls", "_range")
        .orderBy("score")
        .rowsBetween(Window.unboundedPreceding, -1)
    )

    def below(column: str, window) -> Column:
        return F.coalesce(F.sum(column).over(window), F.lit(0))

    inside = (
        place.select("*", positives.alias("_pos"), *[below(c, lower).alias(f"{c}_below") for c in n])
        .groupBy(*by, "cls", "_range")
        .agg(
            F.sum("_pos").alias("_pos"),
            *[F.sum(c).alias(c) for c in n],
            *[F.sum(F.col("_pos") * (F.col(f"{c}_below") + F.col(c) / 2)).alias(f"{c}_wins") for c in n],
        )
    )
    # at most `buckets` rows per group and class from here on
    ranges_before = (
        Window.partitionBy(*by, "cls").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = (
        inside.select("*", *[below(c, ranges_before).alias(f"{c}_before") for c in n])
        .groupBy(*by, "cls")
        .agg(
            F.sum("_pos").alias("n_pos"),
            *[F.sum(c).alias(c) for c in n],
            *[F.sum(F.col(f"{c}_wins") + F.col("_pos") * F.col(f"{c}_before")).alias(f"{c}_wins") for c in n],
        )
    )
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(label).alias("other"), F.col(f"{c}_wins").alias("wins"), F.col(c).alias("n_neg"))
                for c, label in zip(n, labels)
            ]
        )
    ).alias("p")
    return (
        totals.select(*by, "cls", "n_pos", pairs)
        .select(*by, "cls", "p.other", "p.wins", "n_pos", "p.n_neg")
        .filter(F.col("other") != F.col("cls"))
    )


def auc_ovr(scores: DataFrame, labels: Sequence, by: Sequence[str] = (), buckets: int = 256) -> DataFrame:
    """(by…, auc): macro mean over classes of one class against the rest."""
    pairs = pairwise_auc(scores, labels, by, buckets)
    per_class = pairs.groupBy(*by, "cls").agg(
        F.try_divide(F.sum("wins"), F.first("n_pos") * F.sum("n_neg")).alias("auc")
    )
    return per_class.groupBy(*by).agg(F.avg("auc").alias("auc"))


def auc_ovo(scores: DataFrame, labels: Sequence, by: Sequence[str] = (), buckets: int = 256) -> DataFrame:
    """(by…, auc): mean over class pairs, each pair scored in both directions."""
    pairs = pairwise_auc(scores, labels, by, buckets)
    return pairs.groupBy(*by).agg(
        F.avg(F.try_divide(F.col("wins"), F.col("n_pos") * F.col("n_neg"))).alias("auc")
    )


def long_scores(predictions: DataFrame, labels: Sequence, by: Sequence[str] = (), scores: str = "scores") -> DataFrame:
    """Score arrays (one entry per label) as rows (by…, cls, y_true, score)."""
    entries = F.explode(
        F.array(
            *[
                F.struct(F.lit(label).alias("cls"), F.get(scores, F.lit(i)).alias("score"))
                for i, label in enumerate(labels)
            ]
        )
    ).alias("s")
    return predictions.select(*by, "y_true", entries).select(*by, "y_true", "s.cls", "s.score")


def parse_model_name(name: Column | str) -> dict[str, Column]:
    """``model.exclusion[.fraction].suffix`` → its parts; no fraction means 1."""
    parts = F.split(F.col(name) if isinstance(name, str) else name, r"\.")
    return {
        "model": F.get(parts, F.lit(0)),
        "exclusion": F.get(parts, F.lit(1)),
        "fraction": F.when(F.size(parts) == 4, F.get(parts, F.lit(2)).try_cast("double")).otherwise(1.0),
    }


def metrics_long(
    predictions: DataFrame,
    labels: Mapping[str, str] | Sequence[str],
    ensemble_models: Sequence[str] = ("xgb", "catboost"),
) -> DataFrame:
    """Long metrics table over (model, exclusion, fraction, split, fold).

    ``predictions``: model, exclusion, fraction, split (``cv`` or ``test``), fold, row_id, y_true, y_pred
    and optionally ``scores`` (one entry per label). Per-fold rows are joined by the consensus over
    folds (``test_consensus``) and over the folds of the ensemble models (``test_ensemble``).
    """
    by = ["model", "exclusion", "fraction", "split", "fold"]
    display = dict(labels) if isinstance(labels, Mapping) else {v: v for v in labels}
    plain = predictions.select(*by[:4], F.col("fold").cast("string").alias("fold"), "row_id", "y_true", "y_pred")
    test = plain.filter(F.col("split") == "test")

    def voted(rows: DataFrame, split: str, group: Sequence[str]) -> DataFrame:
        winner = F.mode("y_pred", deterministic=True).alias("y_pred")
        out = rows.groupBy(*group, "row_id").agg(F.first("y_true").alias("y_true"), winner)
        if "model" not in group:
            out = out.withColumn("model", F.lit("all"))
        return out.withColumns({"split": F.lit(split), "fold": F.lit("all")}).select(*plain.columns)

    every = plain.unionByName(
        voted(test, "test_consensus", ["model", "exclusion", "fraction"])
    ).unionByName(
        voted(test.filter(F.col("model").isin(*ensemble_models)), "test_ensemble", ["exclusion", "fraction"])
    )
    counts = confusion_counts(every, by)
    none = F.lit(None).cast("string")

    cells = _fill_grid(counts, display, by).select(
        *by,
        F.lit("cm").alias("metric"),
        F.col("n").cast("double").alias("value"),
        F.col("true").cast("string").alias("true"),
        F.col("pred").cast("string").alias("pred"),
        F.concat_ws("_", "true", "pred").alias("set"),
    )
    named = (("precision", "precision"), ("recall", "recall"), ("f1-score", "f1"), ("support", "support"))
    entries = F.explode(
        F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).alias("value")) for m, c in named])
    ).alias("m")
    report = (
        _report(counts, by)
        .select(*by, "class", entries)
        .select(*by, "m.metric", "m.value", none.alias("true"), none.alias("pred"), F.col("class").alias("set"))
    )
    out = cells.unionByName(report)
    if "scores" in predictions.columns:
        scored = long_scores(
            predictions.withColumn("fold", F.col("fold").cast("string")), list(display), by
        )
        ovr = auc_ovr(scored.filter(F.col("split") == "test"), list(display), by)
        ovo = auc_ovo(scored.filter(F.col("split") == "cv"), list(display), by)
        auc = ovo.unionByName(ovr).select(
            *by,
            F.lit("auc").alias("metric"),
            F.col("auc").alias("value"),
            none.alias("true"),
            none.alias("pred"),
            F.lit("full").alias("set"),
        )
        out = out.unionByName(auc)
    return out


def importance_summary(
    contributions: DataFrame,
    by: Sequence[str] = ("model", "exclusion", "fraction", "fold", "class", "feature"),
) -> DataFrame:
    """Mean signed contribution per model, fold, class and feature."""
    return contributions.groupBy(*by).agg(F.avg("value").alias("value"))
