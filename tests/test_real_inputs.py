"""Inputs as users have them: mixed kinds, indented documents, near column names; and what training keeps."""

from dataclasses import replace

import json

import pytest
from pyspark.sql import functions as F

from seriesloom.operators import joins, models
from seriesloom.plans.train import learning_curve
from seriesloom.sources import nested_json, tables


def test_delimited_parquet_and_indented_json_together(spark, tmp_path):
    csv = tmp_path / "a.csv"
    csv.write_text('patient_id,study_uid,series_uid,te,number_of_images\np,st,a,"1\n2",24.0\n')
    parquet = str(tmp_path / "b.parquet")
    spark.sql("SELECT 3 AS number_of_images, 'p' AS patient_id, 'st' AS study_uid, 'b' AS series_uid, 5 AS te").write.parquet(parquet)
    document = tmp_path / "c.json"
    document.write_text(json.dumps({"p": {"st": {"c": {"te": ["7", "8"], "number_of_images": 2}}}}, indent=2))
    out = tables.read_any(spark, [str(document), parquet, str(csv)], multiline=True, whole_file=True)
    found = {r.series_uid: (r.te, r.number_of_images) for r in out.collect()}
    assert found == {"a": ("1\n2", 24.0), "b": ("5", 3.0), "c": ("7 8", 2.0)}


def test_parquet_alone_keeps_its_types(spark, tmp_path):
    path = str(tmp_path / "b.parquet")
    spark.range(1).write.parquet(path)
    assert tables.read_any(spark, path, keys=None).dtypes == [("id", "bigint")]


def test_series_of_scalars_is_one_row_and_bad_text_an_error(spark):
    good = '{"p": {"st": {"s": {"kind": "x", "n": 2}, "none": {"kind": []}}}}'
    df = spark.createDataFrame([(good,), ("  ",), (None,)], "document string")
    rows = nested_json.explode_documents(df, "document").collect()
    assert [(r.series_uid, r.kind, r.n) for r in rows] == [("s", "x", "2")]
    bad = spark.createDataFrame([("{",)], "document string")
    with pytest.raises(Exception, match="not a nested document"):
        nested_json.explode_documents(bad, "document", ["kind"]).collect()


def test_a_column_is_matched_once(spark):
    df = spark.createDataFrame([], "diffusion_bvalue string, echo_tme string")
    known = ["diffusion_bvalue", "diffusion_bvalue_ge", "echo_time"]
    matched, missing = joins.auto_match_columns(df, known)
    assert matched == {"diffusion_bvalue": "diffusion_bvalue", "echo_tme": "echo_time"}
    assert missing == ["diffusion_bvalue_ge"]


def _labelled(spark):
    """The last ten rows lack both numeric features and alone hold the word ``rare``."""
    gap = F.col("id") >= 30
    return spark.range(40).select(
        F.concat(F.lit("st"), "id").alias("study_uid"),
        F.concat(F.lit("se"), "id").alias("series_uid"),
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("class"),
        F.when(gap, "rare").when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("series_description"),
        F.when(gap, "rare").otherwise("x").alias("image_type"),
        F.when(~gap, F.col("id") * 1.0).alias("image_mean"),
        F.when(~gap, F.lit(1.0)).alias("number_of_images"),
    )


def test_vectoriser_learns_from_rows_with_gaps_and_boosting_keeps_them(spark):
    spec = models.TrainSpec(params=(("numTrees", 2), ("maxDepth", 2)))
    prepared = models.prepare(_labelled(spark), spec, ["a", "b"])
    model = models.fit_model(prepared, spec, ["a", "b"])
    assert "series_description:rare" in model.plan.vocabulary
    assert models.usable(prepared, spec).count() == 30
    assert models.usable(prepared, replace(spec, model="xgb")).count() == 40


def test_learning_curve_keeps_roles_and_parameters_apart(spark, monkeypatch):
    seen = []
    rows = spark.createDataFrame([("st", "se", "a")], "study_uid string, series_uid string, y_true string")
    monkeypatch.setattr("seriesloom.plans.train._train", lambda df, spec, *rest: seen.append(spec) or ([], rows))
    spec = models.TrainSpec(params=(("numTrees", 2),), roles=models.STANDARD.restricted(include=["image_type", "echo_time"]))
    learning_curve(rows, spec, [1.0], ["rf", "gbt"], [["echo_time"]], params={"gbt": {"maxIter": 3}})
    assert [s.params for s in seen] == [(("numTrees", 2),), (("maxIter", 3),)]
    assert all(s.roles.text == ("image_type",) and not s.roles.number_token for s in seen)
