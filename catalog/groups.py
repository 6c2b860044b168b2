"""Aggregation, voting, metrics and whole-pipeline queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views
from catalog.registry import query
from catalog.rows import sanitize_sql
from catalog.scalars import MAX_TOKEN, strip_sql
from seriesloom.operators import metrics, summarise
from seriesloom.operators import votes as voting
from seriesloom.operators.clean import sanitize, sort_predictions
from seriesloom.operators.rules import apply_overrides, apply_rule
from seriesloom.plans.predict import override_votes

LABELS = ["ADC", "DCE", "DWI", "Others", "T2W"]
DISPLAY = dict(enumerate(LABELS))

# ---- folding instances -------------------------------------------------------------------------


def _joined(column: str) -> str:
    cell = rf"coalesce(regexp_replace(cast({column} AS varchar), '^nan$|\\|;', '-', 'g'), '-')"
    return f"string_agg(DISTINCT {cell}, ' ' ORDER BY {cell}) AS {column}"


def summarise_sql(keys, text, source, image="round(avg(image_mean), 6) AS image_mean", count="median(number_of_images)"):
    parts = [*keys, *[_joined(c) for c in text], *([image] if image else []), f"{count} AS number_of_images"]
    return f"SELECT {', '.join(parts)} FROM {source} GROUP BY {', '.join(keys)}"


_KEYS = ("study_uid", "series_uid", "patient_id")
_TEXT = (
    "image_type",
    "series_description",
    "manufacturer",
    "diffusion_bvalue",
    "diffusion_bvalue_ge",
    "diffusion_bvalue_siemens",
    "echo_time",
    "sop_class",
    "valid",
)
_TEXT_LI = (
    "image_type",
    "series_description",
    "manufacturer",
    "diffusion_bvalue",
    "diffusion_bvalue_ge",
    "diffusion_bvalue_siemens",
    "echo_time",
    "repetition_time",
    "manufacturer_model_name",
    *views.LI_REST,
)


@query("summarise_series", views.oracle(summarise_sql(_KEYS, _TEXT, "v_instances"), "v_instances"))
def summarise_series(spark, sf_dir):
    df = views.instances(spark, sf_dir).drop("instance_id")
    return summarise.summarise(df).withColumn("image_mean", F.round("image_mean", 6))


@query("summarise_series_li", views.oracle(summarise_sql(_KEYS, _TEXT_LI, "v_instances_li"), "v_instances_li"))
def summarise_series_li(spark, sf_dir):
    df = views.instances_li(spark, sf_dir).drop("instance_id")
    return summarise.summarise(df).withColumn("image_mean", F.round("image_mean", 6))


@query(
    "summarise_study",
    views.oracle(
        summarise_sql(("study_uid", "patient_id"), ("series_uid", *_TEXT), "v_instances"), "v_instances"
    ),
)
def summarise_study(spark, sf_dir):
    df = views.instances(spark, sf_dir).drop("instance_id")
    return summarise.summarise_study(df).withColumn("image_mean", F.round("image_mean", 6))


@query(
    "summarise_frames",
    views.oracle(
        summarise_sql(_KEYS, ("manufacturer",), "v_instances", None, "median(number_of_images)"), "v_instances"
    ),
)
def summarise_frames(spark, sf_dir):
    df = views.instances(spark, sf_dir).select(
        *_KEYS, "manufacturer", F.col("number_of_images").cast("string").alias("number_of_frames")
    )
    return summarise.summarise(df)


@query(
    "join_unique",
    views.oracle(
        """SELECT study_uid, series_uid,
        string_agg(DISTINCT coalesce(image_type, '-'), '|' ORDER BY coalesce(image_type, '-')) AS image_type,
        string_agg(DISTINCT echo_time, '|' ORDER BY echo_time) AS echo_time
        FROM v_instances GROUP BY study_uid, series_uid""",
        "v_instances",
    ),
)
def join_unique(spark, sf_dir):
    return summarise.join_unique(
        views.instances(spark, sf_dir), ["study_uid", "series_uid"], ["image_type", "echo_time"]
    )


@query(
    "count_instances",
    views.oracle(
        """SELECT instance_id, study_uid, series_uid,
        count(*) OVER (PARTITION BY study_uid, series_uid) AS number_of_images FROM v_instances""",
        "v_instances",
    ),
)
def count_instances(spark, sf_dir):
    df = views.instances(spark, sf_dir).select("instance_id", "study_uid", "series_uid")
    return summarise.count_instances(df)


@query("distinct_ids", views.oracle("SELECT DISTINCT study_uid FROM v_instances", "v_instances"))
def distinct_ids(spark, sf_dir):
    return summarise.distinct_ids(views.instances(spark, sf_dir))


# ---- rules -------------------------------------------------------------------------------------

_CLEAN = sanitize_sql("exact", "series", ("study_uid", "series_uid", "patient_id", *_TEXT))


def _has(column: str, token: str) -> str:
    return f"list_contains(regexp_extract_all(lower({column}), '\\S+'), '{token}')"


_BVALUE = (
    "coalesce(nullif(diffusion_bvalue, '-'), nullif(diffusion_bvalue_ge, '-'), "
    "nullif(diffusion_bvalue_siemens, '-'), '-')"
)
_FLAGS = f"""SELECT study_uid, series_uid, patient_id,
    {MAX_TOKEN.format(_BVALUE)} > 0 AND NOT {_has("series_description", "adc")} AND NOT {_has("image_type", "adc")} AS DWI,
    {_has("series_description", "t2")} AND NOT {_has("series_description", "cor")}
      AND NOT {_has("series_description", "sag")} AS T2W,
    contains(image_type, 'adc') OR list_contains(string_split(lower(series_description), ' '), 'adc') AS ADC
    FROM clean"""
_SERIES = summarise_sql(_KEYS, _TEXT, "v_instances")
_FLAG_CTES = {"series": _SERIES, "clean": _CLEAN, "flags": _FLAGS}


def series_votes(df):
    """One made-up vote per series, from the hash of its id."""
    vote = F.when(F.md5("series_uid") < "8", "OTHERS").otherwise("DCE")
    return df.select("study_uid", "series_uid", vote.alias("prediction")).distinct()


_VOTES = """SELECT DISTINCT study_uid, series_uid, patient_id,
    CASE WHEN md5(series_uid) < '8' THEN 'OTHERS' ELSE 'DCE' END AS prediction FROM v_instances"""


@query(
    "rules_sequence_type",
    views.oracle("SELECT study_uid, series_uid, DWI, T2W, ADC FROM flags", "v_instances", **_FLAG_CTES),
)
def rules_sequence_type(spark, sf_dir):
    df = views.instances(spark, sf_dir).drop("instance_id")
    return apply_rule(sanitize(summarise.summarise(df)))


def _override_sql(order=("DWI", "T2W", "ADC")) -> str:
    whens = " ".join(f"WHEN {c} THEN '{c}'" for c in order)
    return views.oracle(
        f"""SELECT v.patient_id, v.study_uid, v.series_uid, prediction,
        CASE {whens} ELSE prediction END AS prediction_heuristics
        FROM votes v JOIN flags f ON v.study_uid = f.study_uid AND v.series_uid = f.series_uid""",
        "v_instances",
        votes=_VOTES,
        **_FLAG_CTES,
    )


def _overridden(spark, sf_dir, last_wins=False):
    df = views.instances(spark, sf_dir).drop("instance_id")
    flags = apply_rule(sanitize(summarise.summarise(df)))
    votes = series_votes(df)
    patients = df.select("study_uid", "series_uid", "patient_id").distinct()
    predictions = votes.join(patients, ["study_uid", "series_uid"])
    predictions = predictions.withColumn("prediction_heuristics", F.col("prediction"))
    return apply_overrides(predictions, flags, last_wins=last_wins)


@query("apply_overrides", _override_sql())
def overrides(spark, sf_dir):
    return _overridden(spark, sf_dir)


@query("apply_overrides_last_wins", _override_sql(("ADC", "T2W", "DWI")))
def overrides_last_wins(spark, sf_dir):
    return _overridden(spark, sf_dir, last_wins=True)


@query("predict_overrides", _override_sql())
def predict_overrides(spark, sf_dir):
    """The batch prediction path without models: fold, clean, rule, override."""
    df = views.instances(spark, sf_dir).drop("instance_id")
    return override_votes(df, series_votes(df))


_LI_CTES = {
    "series": summarise_sql(_KEYS, _TEXT_LI, "v_instances_li"),
    "clean": sanitize_sql("exact", "series", ("study_uid", "series_uid", "patient_id", *_TEXT_LI)),
    "flags": _FLAGS,
}


@query(
    "predict_overrides_li",
    views.oracle(
        """SELECT v.patient_id, v.study_uid, v.series_uid, prediction,
        CASE WHEN DWI THEN 'DWI' WHEN T2W THEN 'T2W' WHEN ADC THEN 'ADC' ELSE prediction END AS prediction_heuristics
        FROM votes v JOIN flags f ON v.study_uid = f.study_uid AND v.series_uid = f.series_uid""",
        "v_instances_li",
        votes=_VOTES.replace("v_instances", "v_instances_li"),
        **_LI_CTES,
    ),
)
def predict_overrides_li(spark, sf_dir):
    df = views.instances_li(spark, sf_dir).drop("instance_id")
    return override_votes(df, series_votes(df))


@query(
    "sort_predictions",
    views.oracle("SELECT study_uid, series_uid, prediction FROM votes", "v_instances", votes=_VOTES),
)
def sorted_predictions(spark, sf_dir):
    return sort_predictions(series_votes(views.instances(spark, sf_dir)))


# ---- votes -------------------------------------------------------------------------------------


@query(
    "consensus_mode",
    views.oracle(
        """SELECT row_id, y_pred AS prediction FROM (
        SELECT row_id, y_pred, row_number() OVER (PARTITION BY row_id ORDER BY count(*) DESC, y_pred) AS r
        FROM v_votes GROUP BY row_id, y_pred) WHERE r = 1""",
        "v_votes",
    ),
)
def consensus_mode(spark, sf_dir):
    return voting.consensus_mode(views.votes(spark, sf_dir), ["row_id"])


@query(
    "average_predictions",
    views.oracle("SELECT row_id, round(avg(y_pred), 6) AS prediction FROM v_votes GROUP BY row_id", "v_votes"),
)
def average_predictions(spark, sf_dir):
    out = voting.average_predictions(views.votes(spark, sf_dir), ["row_id"])
    return out.withColumn("prediction", F.round("prediction", 6))


# ---- metrics -----------------------------------------------------------------------------------

_NAMES = "['" + "', '".join(LABELS) + "']"
_PAIRS = f"""SELECT t.i AS t, p.i AS p, {_NAMES}[t.i + 1] AS "true", {_NAMES}[p.i + 1] AS pred
    FROM range(5) t(i), range(5) p(i)"""


@query(
    "label_grid",
    views.oracle(
        """SELECT "true", pred, count(row_id) AS n FROM pairs
        LEFT JOIN v_votes ON y_true = t AND y_pred = p GROUP BY "true", pred""",
        "v_votes",
        pairs=_PAIRS,
    ),
)
def label_grid(spark, sf_dir):
    return metrics.labelled_grid(views.votes(spark, sf_dir), DISPLAY)


@query(
    "confusion_matrix",
    views.oracle(
        """SELECT fold, "true", pred, (SELECT count(*) FROM v_votes v WHERE v.fold = f.fold AND y_true = t AND y_pred = p) AS n
        FROM pairs, (SELECT DISTINCT fold FROM v_votes) f""",
        "v_votes",
        pairs=_PAIRS,
    ),
)
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(views.votes(spark, sf_dir), DISPLAY, ["fold"])


def _report_ctes(source: str, by: str, name: str = "") -> dict[str, str]:
    """CTEs ending in ``report``: (by, class, precision, recall, f1, support)."""
    per_class = f"""SELECT {by}, class, tp / nullif(predicted, 0) AS precision, tp / nullif(support, 0) AS recall,
        2 * tp / (predicted + support) AS f1, support FROM (
        SELECT {by}, class, cast(sum(tp) AS double) AS tp, cast(sum(predicted) AS double) AS predicted,
            cast(sum(support) AS double) AS support FROM (
          SELECT {by}, cast(y_true AS varchar) AS class, cast(y_true = y_pred AS int) AS tp, 0 AS predicted, 1 AS support FROM {source}
          UNION ALL SELECT {by}, cast(y_pred AS varchar), 0, 1, 0 FROM {source}) GROUP BY {by}, class)"""
    report = f"""SELECT * FROM per_class{name}
        UNION ALL SELECT {by}, 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM per_class{name} GROUP BY {by}
        UNION ALL SELECT {by}, 'weighted avg',
            sum(precision * support) / nullif(sum(CASE WHEN precision IS NOT NULL THEN support END), 0),
            sum(recall * support) / nullif(sum(CASE WHEN recall IS NOT NULL THEN support END), 0),
            sum(f1 * support) / nullif(sum(support), 0), sum(support) FROM per_class{name} GROUP BY {by}"""
    return {f"per_class{name}": per_class, f"report{name}": report}


_ROUNDED = "round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support"
# class 4 is never predicted in fold 1 and class 0 is never true in fold 2
_GAPS = """SELECT row_id, fold, y_true, CASE WHEN fold = 1 AND y_pred = 4 THEN 3 ELSE y_pred END AS y_pred
    FROM {v_votes} WHERE NOT (fold = 2 AND y_true = 0)"""


@query(
    "classification_report",
    views.oracle(
        f"SELECT fold, class, {_ROUNDED} FROM report",
        "v_votes",
        gaps=_GAPS.format(v_votes="v_votes"),
        **_report_ctes("gaps", "fold"),
    ),
)
def classification_report(spark, sf_dir):
    df = spark.sql(_GAPS, v_votes=views.votes(spark, sf_dir))
    out = metrics.classification_report(df, ["fold"])
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


_RANKED = """SELECT cls, other, wins, n_pos, n_neg FROM (
    SELECT p.cls, n.y_true AS other,
      sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END * p.k * n.k) AS wins,
      sum(p.k * n.k) AS pairs FROM tally p JOIN tally n ON p.cls = n.cls AND p.y_true = p.cls AND n.y_true <> n.cls
    GROUP BY ALL) JOIN (SELECT cls, sum(k) AS n_pos FROM tally WHERE y_true = cls GROUP BY cls) USING (cls)
    JOIN (SELECT cls, y_true AS other, sum(k) AS n_neg FROM tally GROUP BY ALL) USING (cls, other)"""
_TALLY = "SELECT cls, y_true, score, count(*) AS k FROM v_scores GROUP BY ALL"


@query(
    "auc_ovr",
    views.oracle(
        """SELECT round(avg(auc), 6) AS auc FROM (
        SELECT cls, sum(wins) / (first(n_pos) * sum(n_neg)) AS auc FROM ranked GROUP BY cls)""",
        "v_scores",
        tally=_TALLY,
        ranked=_RANKED,
    ),
)
def auc_ovr(spark, sf_dir):
    return metrics.auc_ovr(views.scores(spark, sf_dir), range(5)).select(F.round("auc", 6).alias("auc"))


@query(
    "auc_ovo",
    views.oracle(
        "SELECT round(avg(wins / (n_pos * n_neg)), 6) AS auc FROM ranked",
        "v_scores",
        tally=_TALLY,
        ranked=_RANKED,
    ),
)
def auc_ovo(spark, sf_dir):
    return metrics.auc_ovo(views.scores(spark, sf_dir), range(5)).select(F.round("auc", 6).alias("auc"))


@query(
    "r2_score",
    """SELECT event_type, round(1 - sum(power(value - pred, 2)) / sum(power(value - centre, 2)), 6) AS r2 FROM (
    SELECT event_type, value, value * 0.9 + user_id % 5 AS pred, avg(value) OVER (PARTITION BY event_type) AS centre
    FROM events) GROUP BY event_type""",
)
def r2_score(spark, sf_dir):
    df = views.table(spark, sf_dir, "events").selectExpr(
        "event_type", "value AS y_true", "value * 0.9 + user_id % 5 AS y_pred"
    )
    return metrics.r2_score(df, ["event_type"]).withColumn("r2", F.round("r2", 6))


# three result files, whose models err on different rows; every fold is scored on all test rows
_RESULTS = """SELECT split_part(file, '.', 1) AS model, split_part(file, '.', 2) AS exclusion,
      CASE WHEN file LIKE '%.50.pkl' THEN 50e0 ELSE 1e0 END AS fraction, split, fold, row_id, y_true,
      cast((y_pred + CASE WHEN (row_id + fold) % err = 0 THEN 1 ELSE 0 END) % 5 AS int) AS y_pred
    FROM (SELECT *, CASE WHEN file LIKE 'xgb%' THEN 3 WHEN file LIKE 'cat%' THEN 4 ELSE 2 END AS err FROM filed)
    WHERE split = 'test' OR row_id % 5 = fold"""
_FILES = ("xgb.standard.50.pkl", "catboost.standard.50.pkl", "rf.sar:series_description.pkl")
_FILED = f"""SELECT v.*, file, split FROM v_votes v,
    (SELECT unnest([{", ".join(f"'{f}'" for f in _FILES)}]) AS file), (SELECT unnest(['cv', 'test']) AS split)"""


def _voted_sql(source: str, model: str, group: str, split: str) -> str:
    return f"""SELECT {model} AS model, exclusion, fraction, '{split}' AS split, 'all' AS fold, row_id, y_true, y_pred FROM (
        SELECT {group}, row_id, min(y_true) AS y_true, y_pred,
          row_number() OVER (PARTITION BY {group}, row_id ORDER BY count(*) DESC, y_pred) AS r
        FROM {source} GROUP BY {group}, row_id, y_pred) WHERE r = 1"""


_BY = "model, exclusion, fraction, split, fold"


@query(
    "metrics_long",
    views.oracle(
        f"""SELECT {_BY}, 'cm' AS metric, cast((SELECT count(*) FROM every_row e WHERE e.model = g.model AND e.exclusion = g.exclusion
          AND e.fraction = g.fraction AND e.split = g.split AND e.fold = g.fold AND y_true = t AND y_pred = p) AS double) AS value,
          "true", pred, concat("true", '_', pred) AS "set" FROM (SELECT DISTINCT {_BY} FROM every_row) g, pairs
        UNION ALL
        SELECT {_BY}, metric, round(value, 6), NULL, NULL, class FROM (
          SELECT {_BY}, class, unnest(['precision', 'recall', 'f1-score', 'support']) AS metric,
            unnest([precision, recall, f1, support]) AS value FROM report)""",
        "v_votes",
        pairs=_PAIRS,
        filed=_FILED,
        results=_RESULTS,
        every_row=f"""SELECT model, exclusion, fraction, split, cast(fold AS varchar) AS fold, row_id, y_true, y_pred FROM results
            UNION ALL {_voted_sql("(SELECT * FROM results WHERE split = 'test')", "model", "model, exclusion, fraction", "test_consensus")}
            UNION ALL {_voted_sql("(SELECT * FROM results WHERE split = 'test' AND model IN ('xgb', 'catboost'))", "'all'", "exclusion, fraction", "test_ensemble")}""",
        **_report_ctes("every_row", _BY),
    ),
)
def metrics_long(spark, sf_dir):
    files = F.explode(F.array(*[F.lit(f) for f in _FILES])).alias("file")
    splits = F.explode(F.array(F.lit("cv"), F.lit("test"))).alias("split")
    rows = views.votes(spark, sf_dir).select("*", files).select("*", splits)
    rows = rows.filter("split = 'test' OR row_id % 5 = fold")
    error = F.when(F.col("file").startswith("xgb"), 3).when(F.col("file").startswith("cat"), 4).otherwise(2)
    wrong = F.when((F.col("row_id") + F.col("fold")) % error == 0, 1).otherwise(0)
    predictions = rows.withColumn("y_pred", ((F.col("y_pred") + wrong) % 5).cast("int")).withColumns(
        metrics.parse_model_name("file")
    )
    out = metrics.metrics_long(predictions.drop("file"), DISPLAY)
    return out.withColumn("value", F.round("value", 6))


# even rows are a test split, odd ones folds of cross-validation
_SPLIT_TALLY = """SELECT CASE WHEN row_id % 2 = 0 THEN 'test' ELSE 'cv' END AS split, row_id % 4 // 2 AS fold, cls, y_true, score, count(*) AS k
    FROM v_scores GROUP BY ALL"""
_SPLIT_RANKED = """SELECT split, fold, cls, other, wins, n_pos, n_neg FROM (
    SELECT p.split, p.fold, p.cls, n.y_true AS other,
      sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END * p.k * n.k) AS wins
    FROM tally p JOIN tally n ON p.split = n.split AND p.fold = n.fold AND p.cls = n.cls AND p.y_true = p.cls AND n.y_true <> n.cls GROUP BY ALL)
    JOIN (SELECT split, fold, cls, sum(k) AS n_pos FROM tally WHERE y_true = cls GROUP BY ALL) USING (split, fold, cls)
    JOIN (SELECT split, fold, cls, y_true AS other, sum(k) AS n_neg FROM tally GROUP BY ALL) USING (split, fold, cls, other)"""


@query(
    "metrics_long_auc",
    views.oracle(
        """SELECT split, CAST(fold AS varchar) AS fold, round(avg(auc), 6) AS value, 'full' AS "set" FROM (
          SELECT split, fold, cls, sum(wins) / (first(n_pos) * sum(n_neg)) AS auc FROM ranked WHERE split = 'test' GROUP BY ALL) GROUP BY ALL
        UNION ALL SELECT split, CAST(fold AS varchar), round(avg(wins / (n_pos * n_neg)), 6), 'full' FROM ranked WHERE split = 'cv' GROUP BY ALL""",
        "v_scores",
        tally=_SPLIT_TALLY,
        ranked=_SPLIT_RANKED,
    ),
)
def metrics_long_auc(spark, sf_dir):
    """The AUC rows of the long table: one against the rest on the test split, pairs in cross-validation."""
    cells = F.array_sort(F.collect_list(F.struct("cls", "score")))
    rows = views.scores(spark, sf_dir).groupBy("row_id", "y_true").agg(F.transform(cells, lambda x: x["score"]).alias("scores"))
    split = F.when(F.col("row_id") % 2 == 0, "test").otherwise("cv")
    fold = F.floor(F.col("row_id") % 4 / 2)
    rows = rows.select(
        F.lit("rf").alias("model"), F.lit("standard").alias("exclusion"), F.lit(1.0).alias("fraction"), split.alias("split"),
        fold.alias("fold"), "row_id", "y_true", F.col("y_true").alias("y_pred"), "scores",
    )
    out = metrics.metrics_long(rows, list(range(5))).where("metric = 'auc'")
    return out.select("split", "fold", F.round("value", 6).alias("value"), "set")


@query(
    "importance_summary",
    """SELECT 'rf' AS model, fold, class, feature, round(avg(value), 6) AS value FROM (
      SELECT vec_id % 5 AS fold, label % 5 AS class, unnest(embedding)::DOUBLE AS value,
        concat('f', cast(generate_subscripts(embedding, 1) - 1 AS varchar)) AS feature FROM embeddings)
    GROUP BY ALL""",
)
def importance_summary(spark, sf_dir):
    rows = views.table(spark, sf_dir, "embeddings").select(
        F.lit("rf").alias("model"),
        (F.col("vec_id") % 5).alias("fold"),
        (F.col("label") % 5).alias("class"),
        F.posexplode("embedding").alias("at", "value"),
    )
    rows = rows.withColumns(
        {"feature": F.concat(F.lit("f"), F.col("at").cast("string")), "value": F.col("value").cast("double")}
    )
    out = metrics.importance_summary(rows, ("model", "fold", "class", "feature"))
    return out.withColumn("value", F.round("value", 6))


# ---- the web and extraction paths --------------------------------------------------------------


@query(
    "study_features",
    views.oracle(
        rf"""SELECT study_uid, series_uid, study_uid AS patient_id,
        {_joined("series_description")}, {_joined("diffusion_bvalue")}, {_joined("echo_time")},
        cast(count(*) AS double) AS number_of_images FROM (
          SELECT study_uid, series_uid, diffusion_bvalue, {strip_sql("series_description")} AS series_description,
            concat(echo_time, ' ', cast(instance_id % 7 AS string)) AS echo_time FROM v_instances)
        GROUP BY study_uid, series_uid HAVING regexp_matches(lower(first(series_description)), 't2|dce')""",
        "v_instances",
    ),
)
def study_features(spark, sf_dir):
    """The archive path up to scoring: flatten, assemble, fold, filter."""
    from seriesloom.plans.archive import study_features as features

    out = features([views.tags(spark, sf_dir)], filters={"series_description": ["T2", "dce"]})
    return out.select(
        "study_uid", "series_uid", "patient_id", "series_description", "diffusion_bvalue", "echo_time", "number_of_images"
    )


@query(
    "extract_features",
    views.oracle(
        rf"""SELECT instance_id, study_uid, {strip_sql("series_description")} AS series_description, diffusion_bvalue,
        diffusion_bvalue AS diffusion_bvalue_final, '-' AS modality, true AS valid, false AS seg
        FROM v_instances WHERE sop_class <> '1.2.840.10008.5.1.4.1.1.66.4'""",
        "v_instances",
    ),
)
def extract_features(spark, sf_dir):
    from seriesloom.plans.extract import extract_features as extract

    out = extract(views.tags(spark, sf_dir).drop("study_uid", "series_uid"), keep=("instance_id",))
    return out.select(
        "instance_id",
        "study_uid",
        "series_description",
        "diffusion_bvalue",
        "diffusion_bvalue_final",
        "modality",
        "valid",
        "seg",
    )
