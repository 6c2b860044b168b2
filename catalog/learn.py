"""Features, model fitting, search, cross-validation and ensemble scoring.

Training data: series folded from the event instances. The class follows from the user and series
number, a third of it at random, and the description is not among the features.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from catalog import views
from catalog.folds import _fold, _order
from catalog.registry import query
from seriesloom.operators import features, models
from seriesloom.operators.metrics import auc_ovo, auc_ovr, long_scores, metrics_long
from seriesloom.operators.split import group_kfold, subset_rows, tag_split
from seriesloom.operators.summarise import summarise
from seriesloom.plans.predict import predict
from seriesloom.plans.train import learning_curve, train, training_table
from seriesloom.roles import STANDARD
from seriesloom.session import materialise, scratch_path

CLASSES = ("adc", "dce", "dwi", "others", "t2")
ROLES = STANDARD.restricted(exclude=["series_description"])
SPEC = models.TrainSpec(roles=ROLES, params=(("numTrees", 10), ("maxDepth", 5)))
NUMBERS = replace(SPEC, target="image_mean", task="regression", roles=ROLES.restricted(exclude=["image_mean"]))


def _instances(spark, sf_dir):
    return views.instances(spark, sf_dir).drop("instance_id", "sop_class", "valid")


WIDE = models.TrainSpec()  # default forests on all columns


def labelled_li(spark, sf_dir, n: int = 1500):
    """Series of all header columns, with the maker's first word as class and some of them at random; ``n`` of them."""
    series = summarise(views.instances_li(spark, sf_dir).drop("instance_id"), large=False)
    noise = F.conv(F.substring(F.md5("series_uid"), 1, 2), 16, 10).cast("int")
    kind = F.when(noise % 3 == 0, noise % 5).otherwise(F.pmod(F.length("manufacturer") + F.length("series_description"), F.lit(5)))
    labels = F.array(*[F.lit(c.upper()) for c in CLASSES])
    return subset_rows(training_table(series.withColumn("class", F.get(labels, kind.cast("int")))), WIDE.row_key, n)


def _labelled(spark, sf_dir):
    """One clean row per series with its class."""
    series = summarise(_instances(spark, sf_dir))
    number = F.regexp_extract("series_uid", "SE([0-9]+)", 1).cast("bigint")
    noise = F.conv(F.substring(F.md5("series_uid"), 1, 2), 16, 10).cast("int")
    kind = F.when(noise % 3 == 0, noise % 5).otherwise(number % 5)
    labels = F.array(*[F.lit(c.upper()) for c in CLASSES])
    return training_table(series.withColumn("class", F.get(labels, kind.cast("int"))))


def _parts(spark, sf_dir):
    tagged = tag_split(materialise(_labelled(spark, sf_dir)), "study_uid", 0.8)
    a, b = (tagged.filter(F.col("part") == p).drop("part") for p in "ab")
    return a, b


def _trained(spark, sf_dir, n_folds=3, **changes):
    return train(_labelled(spark, sf_dir), replace(SPEC, **changes), n_folds)


@query("assemble_features")
def assemble_features(spark, sf_dir):
    out, plan = features.assemble_features(_labelled(spark, sf_dir), ROLES)
    vector = vector_to_array("features")
    return out.select(
        "study_uid",
        "series_uid",
        F.lit(len(plan.names)).alias("n_features"),
        F.size(vector).alias("width"),
        F.round(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
    )


@query("document_features")
def document_features(spark, sf_dir):
    """The vectoriser over whole documents, with their source as a second text column."""
    df = views.table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("series_description"), F.col("source").alias("manufacturer")
    )
    out, plan = features.assemble_features(df, STANDARD)
    vector = vector_to_array("features")
    return out.select(
        "doc_id",
        F.lit(len(plan.names)).alias("n_features"),
        F.aggregate(vector, F.lit(0.0), lambda a, x: a + x).alias("terms"),
    )


# ---- what SQL can state: a class that is the maker, a number that is another one ------------------------------

MAKERS = ("ge", "philips", "siemens")
RULE = replace(SPEC, roles=STANDARD.restricted(include=["manufacturer", "modality"]), params=(("numTrees", 10), ("maxDepth", 6)))
LINE = replace(SPEC, target="image_mean", task="regression", model="elastic", roles=STANDARD.restricted(include=["number_of_images"]))
_FOLDS = f"""SELECT study_uid, {_fold("r", "n", 3)} AS fold FROM (
    SELECT study_uid, row_number() OVER (ORDER BY {_order("study_uid")}) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT study_uid FROM v_instances))"""
_MAKER = "CASE WHEN manufacturer LIKE 'GE%' THEN 'ge' ELSE lower(manufacturer) END"
_SERIES = f"SELECT DISTINCT study_uid, series_uid, patient_id, {_MAKER} AS maker FROM v_instances"


def _by_maker(spark, sf_dir):
    """One row per series whose class is its maker's first word."""
    series = summarise(_instances(spark, sf_dir).select("study_uid", "series_uid", "patient_id", "manufacturer"), large=False)
    out = training_table(series.withColumn("class", F.split_part("manufacturer", F.lit(" "), F.lit(1))))
    return out.withColumn("modality", F.lit("mr"))


def _learn_maker(spark, sf_dir, **changes):
    _, predictions = train(_by_maker(spark, sf_dir), replace(RULE, **changes), 3)
    return predictions.select("study_uid", "series_uid", F.col("fold").cast("int").alias("fold"), "y_true", "y_pred", F.size("scores").alias("n_scores"))


_VOTED = views.oracle(
    "SELECT study_uid, series_uid, fold, maker AS y_true, maker AS y_pred, 3 AS n_scores FROM series JOIN folds USING (study_uid)",
    "v_instances",
    series=_SERIES,
    folds=_FOLDS,
)


@query("learn_maker_forest", _VOTED)
def learn_maker_forest(spark, sf_dir):
    """Votes of three forests on the studies they have not seen."""
    return _learn_maker(spark, sf_dir)


@query("learn_maker_xgb", _VOTED)
def learn_maker_xgb(spark, sf_dir):
    return _learn_maker(spark, sf_dir, model="xgb", params=(("maxIter", 5),))


@query("learn_maker_lgb", _VOTED)
def learn_maker_lgb(spark, sf_dir):
    return _learn_maker(spark, sf_dir, model="lgb", params=(("maxIter", 5),))


@query("learn_maker_catboost", _VOTED)
def learn_maker_catboost(spark, sf_dir):
    return _learn_maker(spark, sf_dir, model="catboost", params=(("maxIter", 5), ("stepSize", 0.3)))


@query("learn_maker_linear", _VOTED)
def learn_maker_linear(spark, sf_dir):
    return _learn_maker(spark, sf_dir, model="elastic", params=(("maxIter", 50),))


@query("learn_maker_search", _VOTED)
def learn_maker_search(spark, sf_dir):
    """Every fold with the best of two drawn parameter sets."""
    return _learn_maker(spark, sf_dir, search_draws=2, inner_folds=2, params=(("numTrees", 5),))


@query(
    "learn_maker_holdout",
    views.oracle(
        """SELECT fold, study_uid, series_uid, maker AS y_true, maker AS y_pred FROM series
        JOIN (SELECT study_uid FROM (SELECT study_uid, row_number() OVER (ORDER BY """
        + _order("study_uid")
        + """) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT study_uid FROM v_instances)) WHERE r > floor(0.8 * n)) USING (study_uid),
        (SELECT unnest(['0', '1']) AS fold)""",
        "v_instances",
        series=_SERIES,
    ),
)
def learn_maker_holdout(spark, sf_dir):
    """Votes of two fold models on a part that neither has seen."""
    tagged = tag_split(materialise(_by_maker(spark, sf_dir)), "study_uid", 0.8)
    a, b = (tagged.filter(F.col("part") == p).drop("part") for p in "ab")
    fitted, _ = train(a, RULE, 2)
    return models.score_holdout(fitted, b, RULE).select("fold", "study_uid", "series_uid", "y_true", "y_pred")


@query(
    "learn_maker_ensemble",
    views.oracle(
        "SELECT patient_id, study_uid, series_uid, upper(maker) AS prediction, upper(maker) AS prediction_heuristics FROM series",
        "v_instances",
        series=_SERIES,
    ),
)
def learn_maker_ensemble(spark, sf_dir):
    """Instances to series to the consensus of an ensemble that was written and read back."""
    fitted, _ = train(_by_maker(spark, sf_dir), RULE, 2)
    path = scratch_path(spark, "models")
    models.save_models(fitted, path)
    fitted, mode = models.load_models(spark, path)
    return predict(_instances(spark, sf_dir), fitted, mode=mode)


@query(
    "learn_maker_importance",
    views.oracle(
        """SELECT "class", feature, feature = 'manufacturer' AS matters FROM (SELECT DISTINCT maker AS "class" FROM series),
        (SELECT unnest(['manufacturer', 'modality']) AS feature)""",
        "v_instances",
        series=_SERIES,
    ),
)
def learn_maker_importance(spark, sf_dir):
    """Only the column that the class follows from matters when it is shuffled."""
    df = _by_maker(spark, sf_dir)
    fitted, _ = train(df, RULE, 2)
    drops = models.permutation_importance(fitted[0], df, RULE)
    return drops.select("class", "feature", (F.col("value") > 0).alias("matters"))


@query(
    "importance_of_votes",
    views.oracle(
        """SELECT CAST(v.y_true AS varchar) AS "class", CAST(v.fold AS varchar) AS feature, round(any_value(b.q) - avg(CAST(v.y_true = v.y_pred AS int)), 9) AS value
        FROM v_votes v JOIN (SELECT y_true, avg(CAST(y_true = y_pred AS int)) AS q FROM v_votes WHERE fold = 0 GROUP BY y_true) b USING (y_true)
        WHERE v.fold > 0 GROUP BY v.y_true, v.fold""",
        "v_votes",
    ),
)
def importance_of_votes(spark, sf_dir):
    """Drops in recall from votes, the folds taken as permuted columns and the first one as the unchanged rows."""
    variant = F.when(F.col("fold") == 0, models.UNCHANGED).otherwise(F.col("fold").cast("string"))
    votes = views.votes(spark, sf_dir).select(variant.alias("variant"), F.col("y_true").cast("string"), F.col("y_pred").cast("string"))
    return models.importance_of(votes).withColumn("value", F.round("value", 9))


@query(
    "learn_line",
    views.oracle(
        """SELECT study_uid, series_uid, round(y, 3) AS y_true, round(slope * x + start, 3) AS y_pred FROM series,
        (SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS start FROM series)""",
        "v_instances",
        series="""SELECT study_uid, series_uid, median(number_of_images) AS x, 3 * median(number_of_images) + 7 AS y
          FROM v_instances GROUP BY study_uid, series_uid""",
    ),
)
def learn_line(spark, sf_dir):
    """A linear model without penalty on a target that is a line over its one feature."""
    series = summarise(_instances(spark, sf_dir).select("study_uid", "series_uid", "patient_id", "manufacturer", "number_of_images"), large=False)
    table = training_table(series.withColumn("image_mean", 3 * F.col("number_of_images") + 7), "image_mean", "regression")
    _, rows = train(table, replace(LINE, params=(("regParam", 0.0), ("elasticNetParam", 0.0))), 3)
    return rows.select("study_uid", "series_uid", F.round("y_true", 3).alias("y_true"), F.round("y_pred", 3).alias("y_pred"))


@query(
    "vector_features",
    """SELECT doc_id, source, cast(len(list_distinct(regexp_extract_all(lower(source), '[a-z0-9_]{2,}'))) AS double) AS terms
    FROM documents""",
)
def vector_features(spark, sf_dir):
    """Every document's source is one term of the vocabulary, so its vector holds that one and no other."""
    df = views.table(spark, sf_dir, "documents").select("doc_id", "source", F.col("source").alias("manufacturer"))
    out, _ = features.assemble_features(df.withColumn("study_uid", F.lit("s")), STANDARD.restricted(include=["manufacturer"]))
    total = F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, x: a + x)
    return out.select("doc_id", "source", total.alias("terms"))


# ---- models on noisy data: that they run and what shape their results have -----------------------------------


def _fit_and_score(spark, sf_dir, spec, **params):
    df = group_kfold(materialise(_labelled(spark, sf_dir)), "study_uid", 3)
    spec = replace(spec, params=tuple(params.items()))
    labels = CLASSES if spec.task == "classification" else ()
    prepared = models.prepare(df, spec, labels).persist()
    model = models.fit_model(prepared.filter("fold <> 0"), spec, labels)
    return models.predict_rows(model, prepared.filter("fold = 0"), spec.row_key, spec.target)


@query("fit_forest")
def fit_forest(spark, sf_dir):
    return _fit_and_score(spark, sf_dir, SPEC, numTrees=50, maxDepth=8)


@query("fit_forest_regression")
def fit_forest_regression(spark, sf_dir):
    return _fit_and_score(spark, sf_dir, NUMBERS, numTrees=20, maxDepth=6)


@query("fit_boosted")
def fit_boosted(spark, sf_dir):
    return _fit_and_score(spark, sf_dir, replace(SPEC, model="gbt"), maxIter=5, maxDepth=4)


@query("fit_boosted_regression")
def fit_boosted_regression(spark, sf_dir):
    return _fit_and_score(spark, sf_dir, replace(NUMBERS, model="gbt"), maxIter=5, maxDepth=4)


@query("fit_linear")
def fit_linear(spark, sf_dir):
    return _fit_and_score(spark, sf_dir, replace(SPEC, model="elastic"), maxIter=30)


@query("fit_linear_regression")
def fit_linear_regression(spark, sf_dir):
    return _fit_and_score(spark, sf_dir, replace(NUMBERS, model="elastic"), maxIter=30)


@query("search_params")
def search_params(spark, sf_dir):
    spec = replace(SPEC, params=(("numTrees", 5),), inner_folds=3)
    rows = models.prepare(materialise(_labelled(spark, sf_dir)), spec, CLASSES)
    plan = features.fit_features(rows, ROLES)
    featured = PipelineModel(stages=plan.stages()).transform(rows)
    return models.search_params(featured, spec, draws=3)[0]


@query("cv_train")
def cv_train(spark, sf_dir):
    """Confusion, report and AUC of three folds over distinct studies."""
    _, predictions = _trained(spark, sf_dir)
    rows = predictions.withColumns(
        {
            "model": F.lit("rf"),
            "exclusion": F.lit("series_description"),
            "fraction": F.lit(1.0),
            "row_id": F.concat_ws("|", "study_uid", "series_uid"),
        }
    )
    return metrics_long(rows, CLASSES)


@query("cv_train_groups")
def cv_train_groups(spark, sf_dir):
    """One fold per group of a study → group map."""
    df = materialise(_labelled(spark, sf_dir))
    group = F.concat(F.lit("site"), (F.xxhash64("study_uid") % 3 + 3).cast("string"))
    groups = df.select("study_uid", group.alias("group")).distinct().filter("`group` <> 'site1'")
    _, predictions = train(df, SPEC, groups=groups)
    return predictions.groupBy("fold").agg(
        F.count("*").alias("n"), F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy")
    )


@query("score_holdout")
def score_holdout(spark, sf_dir):
    train_rows, test_rows = _parts(spark, sf_dir)
    _, predictions = train(train_rows, SPEC, 3, holdout=test_rows)
    test = long_scores(predictions.filter("split = 'test'"), CLASSES, ["fold"])
    ovr = auc_ovr(test, CLASSES, ["fold"]).withColumnRenamed("auc", "auc_ovr")
    return ovr.join(auc_ovo(test, CLASSES, ["fold"]).withColumnRenamed("auc", "auc_ovo"), "fold")


@query("score_ensemble")
def score_ensemble(spark, sf_dir):
    """Instances → series → all fold models → consensus → rule, at full width."""
    fitted, _ = _trained(spark, sf_dir)
    return predict(_instances(spark, sf_dir), fitted, "prostate_mpmri")


@query("score_ensemble_instances")
def score_ensemble_instances(spark, sf_dir):
    fitted, _ = _trained(spark, sf_dir, n_folds=2)
    return predict(_instances(spark, sf_dir), fitted, "prostate_mpmri", reduce="instance")


@query("permutation_importance")
def permutation_importance(spark, sf_dir):
    train_rows, test_rows = _parts(spark, sf_dir)
    fitted, _ = train(train_rows, SPEC, 2)
    columns = ["manufacturer", "diffusion_bvalue", "echo_time", "image_mean"]
    return models.permutation_importance(fitted[0], test_rows, SPEC, columns)


@query("learning_curve")
def curve(spark, sf_dir):
    train_rows, test_rows = _parts(spark, sf_dir)
    rows = learning_curve(
        train_rows,
        SPEC,
        fractions=(0.5, 1),
        exclusions=(("series_description",), ("series_description", "echo_time")),
        n_folds=2,
        holdout=test_rows,
    )
    return metrics_long(rows.drop("scores"), CLASSES, ensemble_models=("rf",))
