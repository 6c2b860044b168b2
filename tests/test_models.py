"""Fitting, scoring and keeping models, on a table where the class can be learnt."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from seriesloom.operators import models
from seriesloom.operators.features import assemble_features, text_counts
from seriesloom.operators.metrics import auc_ovr, long_scores, metrics_long
from seriesloom.plans.archive import ModelConfig, predict_studies
from seriesloom.plans.predict import predict
from seriesloom.plans.train import train, training_table
from seriesloom.roles import STANDARD

SPEC = models.TrainSpec(params=(("numTrees", 5), ("maxDepth", 5)))


@pytest.fixture(scope="module")
def series(spark):
    """90 series of three classes; the description tells the class, the echo time almost does."""
    return spark.range(90).select(
        F.concat(F.lit("p"), (F.col("id") % 30).cast("string")).alias("patient_id"),
        F.concat(F.lit("st"), (F.col("id") % 30).cast("string")).alias("study_uid"),
        F.concat(F.lit("se"), F.col("id").cast("string")).alias("series_uid"),
        F.element_at(F.array(*[F.lit(c) for c in ("T2", "Adc", "DWI")]), (F.col("id") % 3 + 1).cast("int")).alias("class"),
        F.element_at(
            F.array(*[F.lit(c) for c in (" T2 tse tra", "ADC map", "diff b800 tra")]), (F.col("id") % 3 + 1).cast("int")
        ).alias("series_description"),
        F.concat((F.col("id") % 3 * 10 + F.col("id") % 2).cast("string"), F.lit(" 5")).alias("echo_time"),
        F.when(F.col("id") % 3 == 2, "0 800").otherwise("-").alias("diffusion_bvalue"),
        F.lit("ORIGINAL").alias("image_type"),
        F.when(F.col("id") % 10 != 0, F.col("id") * 1.0).alias("image_mean"),
        F.lit(3.0).alias("number_of_images"),
    )


@pytest.fixture(scope="module")
def trained(spark, series):
    return train(training_table(series), SPEC, 3)


def test_training_table_keeps_what_a_model_may_see(series):
    out = training_table(series.withColumn("inversion_time", F.lit("1")))
    assert "inversion_time" not in out.columns and {"study_uid", "series_uid", "class"} <= set(out.columns)
    assert {r["class"] for r in out.select("class").distinct().collect()} == {"t2", "adc", "dwi"}


def test_vocabulary_share_and_vector_width(series):
    counts = {(r["column"], r.term): r.n_rows for r in text_counts(series, ["series_description"], 0.3).collect()}
    assert counts["series_description", "tra"] == 60 and counts["series_description", "t2 tse tra"] == 30
    out, plan = assemble_features(training_table(series), STANDARD)
    row = out.filter("series_uid = 'se0'").first()
    values = dict(zip(plan.names, row.features.toArray()))
    assert len(plan.names) == len(row.features)
    assert values["series_description:t2 tse"] == 1 and values["series_description:adc"] == 0
    assert values["echo_time:length"] == 2 and values["echo_time:sum"] == 5
    assert values["image_mean"] == -1 and values["number_of_images"] == 3


def test_cross_validation(trained, series):
    fitted, predictions = trained
    rows = predictions.collect()
    assert len(rows) == 90 and len({r.series_uid for r in rows}) == 90
    assert sum(r.y_true == r.y_pred for r in rows) / 90 > 0.95
    per_study = predictions.groupBy("study_uid").agg(F.countDistinct("fold").alias("n"))
    assert per_study.filter("n > 1").count() == 0  # no study in two folds
    scores = long_scores(predictions, fitted[0].labels)
    assert auc_ovr(scores, fitted[0].labels).first().auc > 0.95
    assert models.selected_names(fitted[0]) and "number_of_images" not in models.selected_names(fitted[0])


def test_ensemble_and_rules(trained, series):
    fitted, _ = trained
    out = predict(series.drop("class"), fitted, "prostate_mpmri").collect()
    assert len(out) == 90 and {r.prediction for r in out} == {"T2", "ADC", "DWI"}
    final = {r.prediction: r.prediction_heuristics for r in out}
    assert final == {"T2": "T2W", "ADC": "ADC", "DWI": "DWI"}
    plan = predict(series.drop("class"), fitted)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "Python" not in plan


def test_models_survive_storage(spark, trained, series, tmp_path):
    fitted, _ = trained
    models.save_models(fitted, str(tmp_path / "m"), "exact")
    loaded, mode = models.load_models(spark, str(tmp_path / "m"))
    assert mode == "exact" and len(loaded) == 3
    clean = training_table(series)

    def answers(ms):
        return sorted((r.series_uid, r.prediction) for r in models.score_ensemble(ms, clean).collect())

    assert answers(loaded) == answers(fitted)


def test_groups_holdout_and_metrics(spark, series):
    groups = spark.createDataFrame([(f"st{i}", f"site{i % 3}") for i in range(27)], "study_uid string, group string")
    _, rows = train(training_table(series), SPEC, groups=groups, holdout=training_table(series))
    assert {(r.split, r.fold): r["count"] for r in rows.groupBy("split", "fold").count().collect()} == {
        **{("cv", f"site{i}"): 27 for i in range(3)},
        **{("test", f"site{i}"): 90 for i in range(3)},
    }
    long = rows.withColumns(
        {
            "model": F.lit("xgb"),
            "exclusion": F.lit("standard"),
            "fraction": F.lit(1.0),
            "row_id": F.col("series_uid"),
        }
    )
    table = metrics_long(long, {"adc": "ADC", "dwi": "DWI", "t2": "T2W"})
    kinds = {(r.split, r.metric) for r in table.select("split", "metric").distinct().collect()}
    report = ["cm", "precision", "recall", "f1-score", "support"]
    assert kinds == {
        (s, m)
        for s in ("cv", "test", "test_consensus", "test_ensemble")
        for m in [*report, *(["auc"] if s in ("cv", "test") else [])]
    }
    assert table.filter("split = 'test_ensemble' AND metric = 'cm'").agg(F.sum("value")).first()[0] == 90


def test_search_and_importance(series):
    spec = replace(SPEC, search_draws=2, inner_folds=2, roles=STANDARD.restricted(exclude=["diffusion_bvalue"]))
    fitted, _ = train(training_table(series), spec, 2)
    rows = models.permutation_importance(fitted[0], training_table(series), spec, ["series_description", "image_mean"])
    drop = {(r["class"], r.feature): r.value for r in rows.collect()}
    assert len(drop) == 6
    assert sum(v for (_, f), v in drop.items() if f == "series_description") > sum(
        v for (_, f), v in drop.items() if f == "image_mean"
    )


@pytest.mark.parametrize("model", ["gbt", "elastic"])
def test_other_classifiers(series, model):
    params = {"gbt": (("maxIter", 3), ("maxDepth", 3)), "elastic": (("maxIter", 20),)}[model]
    fitted, rows = train(training_table(series), replace(SPEC, model=model, params=params), 2)
    assert rows.filter("y_true = y_pred").count() > 80
    assert len(rows.first().scores) == 3
    assert models.score_ensemble(fitted, training_table(series)).count() == 90


@pytest.mark.parametrize("model", ["rf", "xgb", "elastic"])
def test_regression(series, model):
    spec = replace(SPEC, model=model, params=(), target="image_mean", task="regression")
    spec = replace(spec, roles=STANDARD.restricted(include=["echo_time", "series_description"]))
    fitted, rows = train(training_table(series, "image_mean", "regression"), spec, 2)
    assert rows.count() == 81  # rows without a target are gone
    out = models.score_ensemble(fitted, training_table(series, "image_mean", "regression"), "prostate_mpmri").first()
    assert out.prediction == out.prediction_heuristics


def test_studies_from_tag_documents(spark, trained):
    body = '{"0020000D":{"Value":["st"]},"0020000E":{"Value":["%s"]},"0008103E":{"Value":["%s"]},"00180081":{"Value":[1,5]}}'
    rows = [(body % ("a", "T2 tse 1/2/2020 tra"),), (body % ("a", "T2 tse 1/2/2020 tra"),), (body % ("b", "localizer"),)]
    documents = spark.createDataFrame(rows, "tags string")
    config = ModelConfig(tuple(trained[0]), "prostate_mpmri", {"series_description": "^T2"})
    out = predict_studies([documents], config).collect()
    assert [(r.patient_id, r.series_uid, r.prediction_heuristics) for r in out] == [("st", "a", "T2W")]


def test_scored_tables_need_not_have_the_training_columns(trained, series):
    """Extra, missing and reordered role columns: the features stay those of the fitted models."""
    fitted, _ = trained
    table = training_table(series)
    key = ["series_uid", "fold"]

    def scores(df):
        return {tuple(r[k] for k in key): r.y_pred for r in models.score_holdout(fitted, df, replace(SPEC, row_key=("series_uid",))).collect()}

    plain = scores(table)
    assert scores(table.withColumn("repetition_time", F.lit("3000 4")).withColumn("image_max", F.lit(9.0))) == plain
    assert scores(table.select(*reversed(table.columns))) == plain
    without = table.drop("image_mean")
    assert scores(without) == scores(table.withColumn("image_mean", F.lit(None).cast("double")))
    assert models.score_ensemble(fitted, table.drop("echo_time", "image_mean")).count() == table.count()
