"""Model registry, parameter search, cross-validated fitting and ensemble scoring."""

from __future__ import annotations

import json
import random
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, replace
from functools import reduce
from itertools import groupby
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    OneVsRest,
    OneVsRestModel,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import CountVectorizerModel, VarianceThresholdSelector, VarianceThresholdSelectorModel, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.operators.clean import class_order
from seriesloom.operators.features import (
    COUNTS,
    GRAMS,
    MISSING_COUNT,
    NUMBERS,
    FeaturePlan,
    add_grams,
    add_numbers,
    fit_features,
    split_columns,
    without_nan_rows,
)
from seriesloom.operators.rules import find_rule, override
from seriesloom.operators.split import group_kfold, hash_rank, stratified_kfold
from seriesloom.operators.votes import mean_of, mode_of
from seriesloom.roles import STANDARD, Roles
from seriesloom.session import materialise


def _log_uniform(low: float, high: float) -> Callable[[random.Random], float]:
    return lambda rng: low * (high / low) ** rng.random()


def _integers(low: int, high: int) -> Callable[[random.Random], int]:
    return lambda rng: rng.randrange(low, high)


def _choice(*values) -> Callable[[random.Random], object]:
    return lambda rng: rng.choice(values)


# ---------------------------------------------------------------------------
# Parameters and search ranges of every model name, as the names'
# users know them. A boosting name's number of leaves is given as a depth.
# ---------------------------------------------------------------------------
_FOREST = {"numTrees": 50, "featureSubsetStrategy": "sqrt", "maxDepth": 10}
_FOREST_RANGES = {"maxDepth": _choice(30, 10, 20), "minInstancesPerNode": _integers(2, 8)}
_LINEAR = {"regParam": 1e-4, "elasticNetParam": 0.15}
_LINEAR_RANGES = {"elasticNetParam": _log_uniform(0.1, 0.99)}
_BOOST = {
    "gbt": {"subsamplingRate": 0.5},
    "xgb": {"subsamplingRate": 0.5, "maxIter": 100, "maxDepth": 6, "stepSize": 0.3},
    "lgb": {"subsamplingRate": 0.5, "maxIter": 100, "maxDepth": 5, "stepSize": 0.1},
    "catboost": {"maxIter": 1000, "maxDepth": 6, "maxBins": 254, "stepSize": 0.03},
}
_XGB_RANGES = {
    "stepSize": _log_uniform(1e-4, 3e-1),
    "maxDepth": _integers(3, 10),
    "minInstancesPerNode": _integers(1, 5),
    "minInfoGain": _log_uniform(1e-4, 1e-1),
}
_BOOST_RANGES = {
    "gbt": _XGB_RANGES,
    "xgb": _XGB_RANGES,
    "lgb": {"maxDepth": _integers(5, 8), "stepSize": _log_uniform(0.01, 0.1), "maxIter": _integers(10, 100)},
    "catboost": {"maxBins": _integers(100, 255), "maxDepth": _integers(4, 9), "stepSize": _log_uniform(1e-2, 3e-1)},
}
# ---------------------------------------------------------------------------

# task → name → (estimator class, fixed parameters, search ranges); callers may add entries
MODELS: dict[str, dict[str, tuple[type, dict, dict]]] = {
    "classification": {
        "rf": (RandomForestClassifier, _FOREST, _FOREST_RANGES),
        "elastic": (LogisticRegression, _LINEAR, _LINEAR_RANGES),
        **{name: (GBTClassifier, _BOOST[name], _BOOST_RANGES[name]) for name in _BOOST},
    },
    "regression": {
        "rf": (RandomForestRegressor, _FOREST, _FOREST_RANGES),
        "elastic": (LinearRegression, _LINEAR, _LINEAR_RANGES),
        **{name: (GBTRegressor, _BOOST[name], _BOOST_RANGES[name]) for name in _BOOST},
    },
}
# models that keep rows with missing numeric features
KEEP_GAPS = ("xgb", "lgb")
# boosting stops when a held-back tenth of the training rows no longer gains
HELD_BACK = "_held_back"
HELD_BACK_SHARE = 0.1


@dataclass(frozen=True)
class TrainSpec:
    """What to train: task, model, parameters and columns."""

    target: str = "class"
    task: str = "classification"
    model: str = "rf"
    params: tuple[tuple[str, object], ...] = ()
    roles: Roles = STANDARD
    row_key: tuple[str, ...] = ("study_uid", "series_uid")
    seed: int = 42
    min_share: float = 0.01
    search_draws: int = 0
    inner_folds: int = 5
    parallelism: int = 2


@dataclass(frozen=True)
class FoldModel:
    """One fold's fitted pipeline and what is needed to use it."""

    pipeline: PipelineModel
    plan: FeaturePlan
    task: str
    labels: tuple[str, ...]
    fold: str


def make_estimator(
    task: str, model: str, params: Mapping[str, object], seed: int, parallelism: int = 1
) -> tuple[Estimator, Estimator]:
    """(estimator, the part that owns the tunable parameters)."""
    kind, fixed, _ = MODELS[task][model]
    base = kind(featuresCol="selected", labelCol="label", **{**fixed, **params})
    if base.hasParam("seed"):
        base = base.setSeed(seed)
    if base.hasParam("validationIndicatorCol"):
        base = base.setParams(validationIndicatorCol=HELD_BACK)
    if kind is GBTClassifier:
        return _StoppingOneVsRest(classifier=base, featuresCol="selected", labelCol="label", parallelism=parallelism), base
    return base, base


class _StoppingOneVsRest(OneVsRest):
    """One-vs-rest whose binary fits see the held-back mark, which Spark's own leaves behind."""

    def _fit(self, dataset: DataFrame) -> OneVsRestModel:
        features, label, classifier = self.getFeaturesCol(), self.getLabelCol(), self.getClassifier()
        n_classes = int(dataset.agg(F.max(label)).first()[0]) + 1
        rows = dataset.select(features, label, HELD_BACK).persist()

        def fit(i: int) -> Model:
            binary = rows.withColumn("_binary", (F.col(label) == i).cast("double"))
            return classifier.copy({classifier.labelCol: "_binary", classifier.featuresCol: features}).fit(binary)

        try:
            models = in_parallel(fit, range(n_classes), self.getParallelism())
        finally:
            rows.unpersist()
        return self._copyValues(OneVsRestModel(models=models)._resetUid(self.uid))


def in_parallel(work: Callable, items: Sequence, threads: int) -> list:
    """``work`` of every item, at most ``threads`` at a time; the threads take over the caller's job properties."""
    with ThreadPool(max(1, min(threads, len(items)))) as pool:
        return pool.map(inheritable_thread_target(SparkSession.active())(work), items)


def draw_params(task: str, model: str, draws: int, seed: int) -> list[dict[str, object]]:
    """Random parameter sets from the model's ranges."""
    ranges = MODELS[task][model][2]
    rng = random.Random(seed)
    return [{name: draw(rng) for name, draw in ranges.items()} for _ in range(draws)]


def _selector() -> VarianceThresholdSelector:
    return VarianceThresholdSelector(featuresCol="features", outputCol="selected", varianceThreshold=0.0)


def label_index(target: str, labels: Sequence[str]) -> Column:
    """Class → index in the sorted label list, NULL when unknown."""
    at = F.array_position(F.array(*[F.lit(v) for v in labels]), F.col(target))
    return F.when(at > 0, (at - 1).cast("double"))


def class_labels(df: DataFrame, target: str) -> tuple[str, ...]:
    """Sorted class labels, as many as there are classes."""
    return tuple(row[target] for row in class_order(df, target).orderBy("class_index").collect())


def prepare(df: DataFrame, spec: TrainSpec, labels: Sequence[str], fitted: Roles | None = None) -> DataFrame:
    """Split feature columns and numeric label; shared by all folds. ``fitted``: the roles of models to score."""
    label = label_index(spec.target, labels) if spec.task == "classification" else F.col(spec.target).cast("double")
    return split_columns(df.withColumn("label", label), fitted or spec.roles, fitted is not None)


def usable(prepared: DataFrame, spec: TrainSpec) -> DataFrame:
    """The prepared rows that the model takes: all, or those with at most one missing numeric feature."""
    return prepared if spec.model in KEEP_GAPS else without_nan_rows(prepared)


def held_back(rows: DataFrame, spec: TrainSpec) -> DataFrame:
    """``rows`` with the mark of the tenth that tells boosting when to stop, chosen by the row key's hash."""
    if HELD_BACK in rows.columns:
        return rows
    place = F.pmod(F.xxhash64(F.lit(spec.seed), *spec.row_key), F.lit(1000))
    return rows.withColumn(HELD_BACK, place < int(1000 * HELD_BACK_SHARE))


def search_params(
    featured: DataFrame, spec: TrainSpec, draws: int = 50
) -> tuple[DataFrame, PipelineModel]:
    """Random search with inner folds over rows that hold ``features`` and ``label``.

    Returns the table (draw, params, metric) and the best pipeline refitted on all rows.
    """
    featured = held_back(featured, spec)
    estimator, tunable = make_estimator(spec.task, spec.model, dict(spec.params), spec.seed, spec.parallelism)
    drawn = draw_params(spec.task, spec.model, draws, spec.seed)
    grid = [{tunable.getParam(name): value for name, value in params.items()} for params in drawn]
    if spec.task == "classification":
        folded = stratified_kfold(featured, spec.row_key, "label", spec.inner_folds, spec.seed, "_inner")
        evaluator = MulticlassClassificationEvaluator(metricName="f1")
    else:
        folded = group_kfold(featured, spec.row_key, spec.inner_folds, spec.seed, "_inner")
        evaluator = RegressionEvaluator(metricName="rmse")
    folded = folded.select("features", "label", "_inner", HELD_BACK).persist()
    try:
        tuned = CrossValidator(
            estimator=Pipeline(stages=[_selector(), estimator]),
            estimatorParamMaps=grid,
            evaluator=evaluator,
            numFolds=spec.inner_folds,
            foldCol="_inner",
            parallelism=spec.parallelism,
            seed=spec.seed,
        ).fit(folded)
    finally:
        folded.unpersist()
    rows = [(i, json.dumps(p, sort_keys=True), float(m)) for i, (p, m) in enumerate(zip(drawn, tuned.avgMetrics))]
    table = featured.sparkSession.createDataFrame(rows, "draw int, params string, metric double")
    return table, tuned.bestModel


def fit_model(train: DataFrame, spec: TrainSpec, labels: Sequence[str], fold: str = "0") -> FoldModel:
    """Fit vectoriser, variance filter and model on prepared rows; the vectoriser learns from all labelled ones."""
    labelled = train.filter(F.col("label").isNotNull())
    plan = fit_features(labelled, spec.roles, spec.min_share)
    front = plan.stages()
    back = _fit_back(PipelineModel(stages=front).transform(usable(labelled, spec)), spec)
    return FoldModel(PipelineModel(stages=[*front, *back.stages]), plan, spec.task, tuple(labels), str(fold))


def _fit_back(featured: DataFrame, spec: TrainSpec) -> PipelineModel:
    """Variance filter and model, with the best of the drawn parameters if the spec asks for a search."""
    if spec.search_draws:
        return search_params(featured, spec, spec.search_draws)[1]
    estimator, _ = make_estimator(spec.task, spec.model, dict(spec.params), spec.seed, spec.parallelism)
    return Pipeline(stages=[_selector(), estimator]).fit(held_back(featured, spec))


def selected_names(model: FoldModel) -> list[str]:
    """Names of the features that passed the variance filter."""
    selector = next(s for s in model.pipeline.stages if hasattr(s, "selectedFeatures"))
    names = model.plan.names
    return [names[i] for i in selector.selectedFeatures]


def _scored(model: FoldModel, prepared: DataFrame) -> DataFrame:
    """Prepared rows with ``prediction`` and, for classes, ``scores``."""
    out = model.pipeline.transform(prepared)
    if model.task == "classification":
        vector = "probability" if "probability" in out.columns else "rawPrediction"
        out = out.withColumn("scores", vector_to_array(vector))
    return out


def predict_rows(model: FoldModel, prepared: DataFrame, keep: Sequence[str], target: str) -> DataFrame:
    """(keep…, fold, y_true, y_pred, scores) of prepared rows; labels as text for classes."""
    rows = _scored(model, prepared)
    if model.task == "classification":
        decoded = F.get(F.array(*[F.lit(v) for v in model.labels]), F.col("prediction").cast("int"))
        columns = [F.col(target).alias("y_true"), decoded.alias("y_pred"), F.col("scores")]
    else:
        columns = [F.col("label").alias("y_true"), F.col("prediction").alias("y_pred")]
    return rows.select(*keep, F.lit(model.fold).alias("fold"), *columns)


def cv_train(
    df: DataFrame, spec: TrainSpec, fold: str = "fold", folds: Sequence | None = None
) -> tuple[list[FoldModel], DataFrame]:
    """One model per value of the ``fold`` column, fitted on the other folds, and its predictions.

    Every fold's vectoriser only ever sees its training rows: a term that is frequent among them is not much
    rarer among all, so the rows are counted once over the terms that any fold could need, and a fold takes
    those that its training rows have often enough. What is kept in memory are these sparse counts. Up to
    ``spec.parallelism`` folds are fitted at a time. ``folds`` spares finding the fold values.
    """
    labels = class_labels(df, spec.target) if spec.task == "classification" else ()
    if folds is None:
        folds = sorted(row[0] for row in df.select(fold).distinct().collect())
    counted, plans = _counted_by_fold(prepare(df, spec, labels), spec, fold, folds)
    counted = counted.persist()

    def fit(value) -> tuple[FoldModel, DataFrame]:
        plan, terms = plans[value]
        front = _sliced(plan, terms)
        inside = F.col(fold) == F.lit(value)
        rows = usable(counted.filter(~inside & F.col("label").isNotNull()), spec)
        back = _fit_back(PipelineModel(stages=front).transform(rows), spec)
        model = FoldModel(PipelineModel(stages=[*plan.stages(), *back.stages]), plan, spec.task, tuple(labels), str(value))
        on_counts = replace(model, pipeline=PipelineModel(stages=[*front, *back.stages]))
        return model, predict_rows(on_counts, usable(counted.filter(inside), spec), spec.row_key, spec.target)

    try:
        fitted = in_parallel(fit, list(folds), spec.parallelism)
        predictions = materialise(reduce(DataFrame.unionByName, [rows for _, rows in fitted]), "predictions")
    finally:
        counted.unpersist()
    return [model for model, _ in fitted], predictions


def _counted_by_fold(prepared: DataFrame, spec: TrainSpec, fold: str, folds: Sequence):
    """Rows with the counts of all terms that a fold may need, and per fold its plan and the places of its terms."""
    labelled = prepared.filter(F.col("label").isNotNull() & F.col(fold).isNotNull())
    sizes = {row[0]: row.n for row in labelled.groupBy(fold).agg(F.count(F.lit(1)).alias("n")).collect()}
    n_all = sum(sizes.values())
    n_train = {value: n_all - sizes.get(value, 0) for value in folds}
    share = spec.min_share * min(n_train.values()) / max(n_all, 1)
    widest = fit_features(labelled, spec.roles, share * (1 - 1e-9))
    if not widest.vocabulary:
        return prepared.drop(GRAMS), {value: (widest, []) for value in folds}
    counter = CountVectorizerModel.from_vocabulary(widest.vocabulary, inputCol=GRAMS, outputCol=COUNTS, binary=True)
    counted = counter.transform(prepared).drop(GRAMS)
    per_fold = counted.filter(F.col("label").isNotNull() & F.col(fold).isNotNull()).groupBy(fold).agg(Summarizer.sum(F.col(COUNTS)).alias("sums"))
    sums = {row[0]: row.sums.toArray() for row in per_fold.collect()}
    total = sum(sums.values())
    plans = {}
    for value in folds:
        held = total - sums.get(value, 0.0)
        terms = [int(i) for i in np.flatnonzero(held >= spec.min_share * n_train[value])]
        plans[value] = (FeaturePlan(widest.roles, [widest.vocabulary[i] for i in terms]), terms)
    return counted, plans


def _sliced(plan: FeaturePlan, terms: Sequence[int]) -> list:
    """As ``plan.stages()``, from rows counted over a wider vocabulary in which the plan's terms are at ``terms``."""
    *front, assembler = plan.stages()
    if not terms:
        return [*front, assembler]
    slicer = VectorSlicer(inputCol=COUNTS, outputCol="_own_counts", indices=list(terms))
    joined = VectorAssembler(inputCols=["_own_counts", NUMBERS], outputCol=assembler.getOutputCol(), handleInvalid="keep")
    return [slicer, *[stage for stage in front if not isinstance(stage, CountVectorizerModel)], joined]


def score_holdout(models: Sequence[FoldModel], df: DataFrame, spec: TrainSpec) -> DataFrame:
    """Predictions of every fold model on a held-out table; its features are those the models were fitted on."""
    prepared = usable(prepare(df, spec, models[0].labels, models[0].plan.roles), spec)
    parts = [predict_rows(m, prepared, spec.row_key, spec.target) for m in models]
    return materialise(reduce(DataFrame.unionByName, parts), "predictions")


def ensemble_votes(models: Sequence[FoldModel], df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Table with one vote column per fold model. All models run in one pass without a shuffle.

    A row's terms are counted once, over the terms of all models with the same number columns; every model
    then takes the entries that passed its own vocabulary and variance filter straight out of that vector.
    """
    texts = dict.fromkeys(c for m in models for c in m.plan.roles.text)
    out = add_grams(df, Roles(text=tuple(texts)))
    votes: list[str] = []
    for _, alike in groupby(models, key=lambda m: (m.plan.roles.number_token, m.plan.roles.numeric)):
        fold_models = list(alike)
        out = add_numbers(out, fold_models[0].plan.roles)
        vocabulary = sorted({term for m in fold_models for term in m.plan.vocabulary})
        whole = FeaturePlan(fold_models[0].plan.roles, vocabulary)
        place = {name: i for i, name in enumerate(vocabulary)}
        out = PipelineModel(stages=whole.stages("_all")).transform(out).drop(NUMBERS, MISSING_COUNT, COUNTS)
        for model in fold_models:
            entries = [place[t] for t in model.plan.vocabulary] + [*range(len(vocabulary), len(whole.names))]
            *_, selector, predictor = model.pipeline.stages
            if not isinstance(selector, VarianceThresholdSelectorModel):
                raise ValueError(f"the pipeline of fold {model.fold} is not one of fit_model or cv_train")
            chosen = VectorSlicer(inputCol="_all", outputCol=selector.getOutputCol(), indices=[entries[i] for i in selector.selectedFeatures])
            vote = F.col("prediction")
            if model.task == "classification":
                vote = F.upper(F.get(F.array(*[F.lit(v) for v in model.labels]), vote.cast("int")))
            name = f"_vote{len(votes)}"
            scored = predictor.transform(chosen.transform(out)).withColumn(name, vote)
            out = scored.select(*out.columns, name)
            votes.append(name)
        out = out.drop("_all")
    return out.drop(GRAMS), votes


def score_ensemble(
    models: Sequence[FoldModel], df: DataFrame, rule: str | None = None, last_wins: bool = False
) -> DataFrame:
    """(patient_id, study_uid, series_uid, prediction, prediction_heuristics) of clean series rows.

    Classes take the consensus of all fold models and then the rule; numbers take their mean. The rule
    is evaluated on the same row, so nothing is joined.
    """
    voted, votes = ensemble_votes(models, df)
    columns = [F.col(v) for v in votes]
    is_class = models[0].task == "classification"
    prediction = mode_of(columns) if is_class else mean_of(columns)
    out = voted.withColumn("prediction", prediction)
    final = F.col("prediction")
    if is_class and rule is not None:
        final = override(final, find_rule(rule)(out), last_wins)
    patient = F.col("patient_id") if "patient_id" in df.columns else F.col("study_uid")
    return out.select(
        patient.alias("patient_id"), "study_uid", "series_uid", "prediction", final.alias("prediction_heuristics")
    )


UNCHANGED = ""  # the variant of a row in which no column is another row's


def permuted_votes(
    model: FoldModel, df: DataFrame, spec: TrainSpec, columns: Sequence[str] | None = None
) -> DataFrame:
    """(variant, row key…, fold, y_true, y_pred, scores): the model's votes on rows with one column shuffled at a time.

    Every row stands beside another one, found along two seeded orders of the row key per hash bucket, and
    becomes one variant per column, which has the other row's value there, and one that is unchanged. All
    variants go through the model in one pass.
    """
    roles = model.plan.roles
    names = list(columns or [*roles.text, *roles.number_token, *roles.numeric])
    own = dict.fromkeys([*spec.row_key, spec.target, *roles.text, *roles.number_token, *roles.numeric])
    taken = hash_rank(df.select(*[c for c in own if c in df.columns]), spec.row_key, spec.seed, "_place")
    names = [c for c in names if c in df.columns]
    others = df.select(*spec.row_key, *[F.col(c).alias(f"_other_{c}") for c in names])
    given = hash_rank(others, spec.row_key, spec.seed + 1, "_place").drop(*spec.row_key)
    both = taken.join(given, "_place").withColumn("variant", F.explode(F.array(*[F.lit(v) for v in (UNCHANGED, *names)])))
    swapped = {c: F.when(F.col("variant") == c, F.col(f"_other_{c}")).otherwise(F.col(c)) for c in names}
    rows = both.withColumns(swapped).select("variant", *taken.drop("_place").columns)
    return predict_rows(model, prepare(rows, spec, model.labels, roles), ["variant", *spec.row_key], spec.target)


def importance_of(votes: DataFrame, task: str = "classification") -> DataFrame:
    """(class, feature, value) from permuted votes: by how much a variant falls behind the unchanged rows.

    For classes that is the drop in each class's recall, for numbers the drop in −MSE (class ``all``).
    """
    if task == "classification":
        hit = (F.col("y_true") == F.col("y_pred")).cast("double")
        scored = votes.groupBy("variant", F.col("y_true").alias("class")).agg(F.avg(F.coalesce(hit, F.lit(0.0))).alias("q"))
    else:
        error = F.col("y_true") - F.col("y_pred")
        scored = votes.groupBy("variant").agg((-F.avg(error * error)).alias("q")).withColumn("class", F.lit("all"))
    # one small struct per class and variant
    of_class = scored.groupBy("class").agg(
        F.max(F.when(F.col("variant") == UNCHANGED, F.col("q"))).alias("base"),
        F.collect_list(F.when(F.col("variant") != UNCHANGED, F.struct("variant", "q"))).alias("variants"),
    )
    each = of_class.select("class", "base", F.explode("variants").alias("v"))
    return each.select("class", F.col("v.variant").alias("feature"), (F.col("base") - F.col("v.q")).alias("value"))


def permutation_importance(
    model: FoldModel, df: DataFrame, spec: TrainSpec, columns: Sequence[str] | None = None
) -> DataFrame:
    """(class, feature, value): drop in each class's recall (or in −MSE) when one column is shuffled; one scoring job."""
    return importance_of(permuted_votes(model, df, spec, columns), model.task)


def save_models(models: Sequence[FoldModel], path: str, mode: str = "exact") -> None:
    """Write an ensemble below ``path``, with the sanitising mode it was trained with."""
    spark = SparkSession.active()
    notes = []
    for i, model in enumerate(models):
        model.pipeline.write().overwrite().save(f"{path}/fold{i}")
        notes.append(
            (
                i,
                json.dumps(
                    {
                        "roles": asdict(model.plan.roles),
                        "vocabulary": model.plan.vocabulary,
                        "task": model.task,
                        "labels": model.labels,
                        "fold": model.fold,
                        "mode": mode,
                    }
                ),
            )
        )
    table = spark.createDataFrame(notes, "i int, note string")
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/notes")


def load_models(spark: SparkSession, path: str) -> tuple[list[FoldModel], str]:
    """Ensemble and its sanitising mode."""
    models, mode = [], "exact"
    for row in spark.read.parquet(f"{path}/notes").orderBy("i").collect():
        note = json.loads(row.note)
        roles = {k: tuple(v) if isinstance(v, list) else v for k, v in note["roles"].items()}
        plan = FeaturePlan(Roles(**roles), note["vocabulary"])
        pipeline = PipelineModel.load(f"{path}/fold{row.i}")
        models.append(FoldModel(pipeline, plan, note["task"], tuple(note["labels"]), note["fold"]))
        mode = note["mode"]
    return models, mode
