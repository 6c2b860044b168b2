"""DataFrame operators on small tables, against brute force."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seriesloom.operators import clean, joins, metrics, pixels, split, summarise, votes
from seriesloom.operators.rules import apply_overrides, apply_rule
from seriesloom.roles import HEADER_TAGS, STANDARD, tag_key_names


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


# ---- cleaning ----------------------------------------------------------------------------------


def test_sanitize_modes(spark):
    df = spark.createDataFrame(
        [(" T2_TSE ", "1.5 2", "", "Keep Me"), ("_", "", "-", "x"), (None, None, None, None)],
        "series_description string, echo_time string, number_of_echos string, patient_id string",
    )
    exact = clean.sanitize(df).collect()
    assert tuple(exact[0]) == ("t2_tse", "1.5 2", "1", "Keep Me")
    assert tuple(exact[1]) == ("", "", "-", "x")
    assert tuple(exact[2]) == (None, None, None, None)
    inside = clean.sanitize(df, "substring").collect()
    assert tuple(inside[0]) == ("t2 tse", "1 5 2", "1", "Keep Me")
    assert inside[1].number_of_echos == "1"
    with pytest.raises(ValueError):
        clean.sanitize(df, "other")


def test_role_lists():
    assert (len(STANDARD.text), len(STANDARD.number_token), len(STANDARD.numeric)) == (19, 18, 20)
    assert (len(STANDARD.drop), len(STANDARD.defaults), len(STANDARD.image)) == (12, 7, 23)
    names = tag_key_names()
    assert len(HEADER_TAGS) == 41 and len(names) == 40
    assert names["0008,103e"] == "series_description" and names["0020,000d"] == "study_uid"


def test_filters(spark):
    df = spark.createDataFrame([("T2 tra", "A"), ("dwi", None), (None, "B")], "d string, m string")
    assert rows_of(clean.filter_regex(df, {"d": ["T2", "x"]})) == [("T2 tra", "A")]
    assert rows_of(clean.filter_tags_exact(df, {"m": ["A", "B"]}).select("m")) == [("A",), ("B",)]
    assert clean.filter_tags_exact(df, {"absent": "x"}).count() == 0
    assert clean.filter_regex(df, None).count() == 3


def test_drop_nan_rows(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, nan, 1.0), (None, nan, 1.0), (1.0, 1.0, 1.0)], "a double, b double, c double")
    assert clean.drop_nan_rows(df, ["a", "b", "c"]).count() == 2


def test_validity(spark):
    seg = "1.2.840.10008.5.1.4.1.1.66.4"
    df = spark.createDataFrame([(1, "x"), (2, seg), (3, None)], "i int, sop_class string")
    flags = {r.i: (r.valid, r.seg) for r in clean.with_validity(df).collect()}
    assert flags == {1: (True, False), 2: (True, True), 3: (False, False)}
    assert [r.i for r in clean.filter_valid(clean.with_validity(df)).collect()] == [1]


def test_max_bvalue_leaves_unparsable_series_whole(spark):
    schema = "i int, study_uid string, series_uid string, diffusion_bvalue string, diffusion_bvalue_siemens string, diffusion_bvalue_ge string, manufacturer string"
    df = spark.createDataFrame(
        [
            (1, "a", "s", "0", "-", "-", "x"),
            (2, "a", "s", "800", "-", "-", "x"),
            (3, "b", "s", "0", "-", "-", "x"),
            (4, "b", "s", "800?", "-", "-", "x"),
            (5, "c", None, "-", "50", "9", "SIEMENS"),
            (6, "c", None, "-", "100", "7", "SIEMENS"),
            (7, "d", "s", "-", "100", "7", "GE MEDICAL"),
            (8, "d", "s", "-", "200", "5", "GE MEDICAL"),
        ],
        schema,
    )
    kept = clean.filter_max_bvalue(df, order="i")
    assert kept.columns == df.columns
    assert sorted(r.i for r in kept.collect()) == [2, 3, 4, 6, 7]


def test_variance_filter(spark):
    df = spark.createDataFrame([(1.0, 2.0, float("nan")), (2.0, 2.0, float("nan"))], "a double, b double, c double")
    assert clean.variance_filter(df, ["a", "b", "c"]).columns == ["a"]


def test_unions(spark):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    with pytest.raises(ValueError):
        clean.union_vertical([a, spark.createDataFrame([(1, 2)], "k int, v int")])
    wide = clean.union_diagonal([a, spark.createDataFrame([(2, True)], "k int, w boolean")])
    assert sorted(wide.collect(), key=str) == [(1, "x", None), (2, None, True)]


# ---- folding -----------------------------------------------------------------------------------


def test_summarise_cells(spark):
    df = spark.createDataFrame(
        [
            ("p", "st", "s", "a\\b;c", 1.0, "3"),
            ("p", "st", "s", "nan", 2.0, "4"),
            ("p", "st", "s", None, None, "x"),
            ("p", "st", "s", "a\\b;c", 3.0, "9"),
            ("p", "st", None, "", None, "1"),
        ],
        "patient_id string, study_uid string, series_uid string, image_type string, image_mean double, number_of_images string",
    )
    out = {r.series_uid: r for r in summarise.summarise(df).collect()}
    assert (out["s"].image_type, out["s"].image_mean, out["s"].number_of_images) == ("- a-b-c", 2.0, 4.0)
    assert (out[None].image_type, out[None].image_mean, out[None].number_of_images) == ("", None, 1.0)
    counted = summarise.summarise(df.drop("number_of_images"))
    assert {r.series_uid: r.number_of_images for r in counted.collect()} == {"s": 4.0, None: 1.0}
    frames = df.withColumn("number_of_frames", F.lit("7"))
    assert "number_of_frames" not in summarise.summarise(frames).columns
    with pytest.raises(ValueError):
        summarise.summarise(df, ["absent"])


def exchanges(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.count("Exchange hashpartitioning"), text


def test_summarise_needs_one_shuffle(spark):
    df = spark.range(100).selectExpr(
        "cast(id % 5 as string) study_uid", "cast(id % 3 as string) series_uid", "cast(id as string) image_type"
    )
    count, text = exchanges(apply_rule_on(summarise.summarise(df)))
    assert count == 1
    assert "partial_collect_set" in text and "Python" not in text


def apply_rule_on(series):
    series = series.withColumns({"series_description": F.lit("t2"), "diffusion_bvalue": F.lit("0 800")})
    return apply_rule(clean.sanitize(series))


def test_hot_series_counts_survive_skew_splitting(spark):
    """A third of all rows in one series; the join back is split by adaptive execution."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df = spark.range(0, 60000, 1, 6).selectExpr(
            "id", "'a' study_uid", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE cast(id % 700 as string) END series_uid"
        )
        out = summarise.count_instances(df)
        rows = out.collect()
        assert len(rows) == 60000
        assert {r.number_of_images for r in rows if r.series_uid == "hot"} == {20000}
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


# ---- rules and joins ---------------------------------------------------------------------------


def test_rule_and_override_order(spark):
    df = spark.createDataFrame(
        [
            ("a", "1", "dwi", "x", "0 800", "-", "-"),
            ("a", "2", "t2 tra", "x", "500", "-", "-"),
            ("a", "3", "ep2d adc", "x", "500", "-", "-"),
            ("a", "4", "map", "derived-adc", "-", "0", "-"),
            ("a", "5", "map", "x", "-", "-", "50"),
            ("a", "6", "map", "x ADC", "-", "-", "-"),
        ],
        "study_uid string, series_uid string, series_description string, image_type string, diffusion_bvalue string, diffusion_bvalue_ge string, diffusion_bvalue_siemens string",
    )
    flags = apply_rule(df)
    found = {r.series_uid: (r.DWI, r.T2W, r.ADC) for r in flags.collect()}
    assert found == {
        "1": (True, False, False),
        "2": (True, True, False),
        "3": (False, False, True),
        "4": (False, False, True),
        "5": (True, False, False),
        "6": (False, False, False),
    }
    votes_df = df.select(
        F.lit("p").alias("patient_id"), "study_uid", "series_uid", F.lit("OTHERS").alias("prediction")
    ).withColumn("prediction_heuristics", F.col("prediction"))
    first = {r.series_uid: r.prediction_heuristics for r in apply_overrides(votes_df, flags).collect()}
    assert first == {"1": "DWI", "2": "DWI", "3": "ADC", "4": "ADC", "5": "DWI", "6": "OTHERS"}
    last = apply_overrides(votes_df, flags, last_wins=True).collect()
    assert {r.series_uid: r.prediction_heuristics for r in last}["2"] == "T2W"


def test_auto_match_columns(spark):
    df = spark.createDataFrame([("1", "2")], "EchoTime string, Whatever string")
    matched, missing = joins.auto_match_columns(df, ["echo_time", "flip_angle"])
    assert matched == {"EchoTime": "echo_time"} and missing == ["flip_angle"]


# ---- splits ------------------------------------------------------------------------------------


def ids(spark, n, copies=3):
    return spark.range(n * copies).selectExpr("id", f"concat('st', cast(id % {n} as string)) study_uid")


@pytest.mark.parametrize("n, ratio", [(97, 0.8), (1, 0.8), (10, 0.0), (10, 1.0)])
def test_split_is_exact_disjoint_and_complete(spark, n, ratio):
    df = ids(spark, n)
    a, b = split.split_by_id(df, "study_uid", ratio)
    left, right = ({r.study_uid for r in part.collect()} for part in (a, b))
    assert len(left) == int(ratio * n) and len(right) == n - len(left)
    assert not left & right and a.count() + b.count() == n * 3
    other = split.split_by_id(df, "study_uid", ratio, seed=7)[0]
    if n == 97:
        assert {r.study_uid for r in other.collect()} != left


@pytest.mark.parametrize("n, k", [(103, 5), (5, 5), (3, 5)])
def test_kfold_sizes(spark, n, k):
    folded = split.group_kfold(ids(spark, n), "study_uid", k).select("study_uid", "fold").distinct().collect()
    assert len(folded) == n
    sizes = Counter(r.fold for r in folded)
    assert [sizes[i] for i in range(k)] == [n // k + (i < n % k) for i in range(k)]


def test_subset_and_strata(spark):
    df = ids(spark, 50, 2)
    assert split.subset_rows(df, "id", 0.25).count() == 25
    assert split.subset_rows(df, "id", 30).count() == 30
    assert split.subset_rows(df, "id", 1000).count() == 100
    kinds = df.withColumn("kind", F.when(F.col("id") < 13, "rare").otherwise("usual"))
    counts = Counter((r.kind, r.fold) for r in split.stratified_kfold(kinds, "id", "kind", 5).collect())
    assert sorted(counts["rare", i] for i in range(5)) == [2, 2, 3, 3, 3]
    assert sum(counts.values()) == 100


def test_splitting_does_not_shuffle_the_rows(spark):
    df = split.group_kfold(ids(spark, 50), "study_uid", 5)
    main = df._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]
    assert "Exchange" not in main and "Join" not in main


def test_hash_rank_is_a_permutation(spark):
    df = spark.range(1000)
    ranks = split.hash_rank(df, "id", 3, "place").collect()
    assert sorted(r.place for r in ranks) == list(range(1, 1001))


# ---- votes and metrics -------------------------------------------------------------------------


def test_consensus_ties_go_to_the_smallest(spark):
    ballots = spark.createDataFrame(
        [(1, "b"), (1, "a"), (2, "c"), (2, "c"), (2, "a"), (3, "b")], "row_id int, y_pred string"
    )
    assert rows_of(votes.consensus_mode(ballots, ["row_id"])) == [(1, "A"), (2, "C"), (3, "B")]
    wide = spark.createDataFrame([("b", "a", "c"), ("c", "c", "a"), ("b", "b", "b")], "x string, y string, z string")
    mode = votes.mode_of([F.col(c) for c in "xyz"])
    assert [r.m for r in wide.select(mode.alias("m")).collect()] == ["a", "c", "b"]
    assert [r.m for r in wide.select(votes.mode_of([F.col("x")]).alias("m")).collect()] == ["b", "c", "b"]


def test_report_leaves_undefined_out(spark):
    pairs = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")]
    df = spark.createDataFrame(pairs, "y_true string, y_pred string")
    report = {r["class"]: r for r in metrics.classification_report(df).collect()}
    assert report["c"].precision is None and report["c"].recall == 0 and report["c"].f1 == 0
    assert report["macro avg"].precision == pytest.approx((0.5 + 0.5) / 2)
    assert report["weighted avg"].recall == pytest.approx(2 / 4)  # the accuracy
    assert report["macro avg"].support == 4
    cells = metrics.confusion_matrix(df, {"a": "A", "b": "B", "c": "C"}).collect()
    assert len(cells) == 9 and sum(r.n for r in cells) == 4


def brute_auc(rows, positive, negative, cls):
    up = [s[cls] for y, s in rows if y == positive]
    down = [s[cls] for y, s in rows if y in negative]
    wins = sum((a > b) + (a == b) / 2 for a in up for b in down)
    return wins / (len(up) * len(down))


@pytest.mark.parametrize("buckets", [2, 7, 64])
def test_auc_matches_pair_counting(spark, buckets):
    rng = random.Random(5)
    labels = ["x", "y", "z"]
    rows = []
    for _ in range(120):
        y = rng.choice(labels)
        rows.append((y, {c: round(rng.random() + (c == y) * 0.4, 1) for c in labels}))
    long = [(i, y, c, s[c]) for i, (y, s) in enumerate(rows) for c in labels]
    df = spark.createDataFrame(long, "row_id int, y_true string, cls string, score double")
    ovr = [brute_auc(rows, c, [o for o in labels if o != c], c) for c in labels]
    ovo = [brute_auc(rows, c, [o], c) for c in labels for o in labels if o != c]
    assert metrics.auc_ovr(df, labels, buckets=buckets).first().auc == pytest.approx(sum(ovr) / 3)
    assert metrics.auc_ovo(df, labels, buckets=buckets).first().auc == pytest.approx(sum(ovo) / 6)


def test_auc_of_no_rows(spark):
    empty = spark.createDataFrame([], "g int, y_true string, cls string, score double")
    assert metrics.auc_ovr(empty, ["a", "b"], ["g"]).count() == 0


def test_r2(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (4.0, 3.0)], "y_true double, y_pred double")
    mean = 7 / 3
    expected = 1 - (0.25 + 1) / sum((y - mean) ** 2 for y in (1, 2, 4))
    assert metrics.r2_score(df).first().r2 == pytest.approx(expected)
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 1.0)], "y_true double, y_pred double")
    assert metrics.r2_score(flat).first().r2 == 0.0


def test_model_names(spark):
    df = spark.createDataFrame([("xgb.standard.10.pkl",), ("rf.sar:x.pkl",)], "f string")
    out = df.select(*[c.alias(n) for n, c in metrics.parse_model_name("f").items()]).collect()
    assert [tuple(r) for r in out] == [("xgb", "standard", 10.0), ("rf", "sar:x", 1.0)]


# ---- pixels ------------------------------------------------------------------------------------


def test_pixel_shapes_and_invariance(spark):
    """Hu moments stay the same when the picture is moved; a uniform line has one zero eigenvalue."""
    shape = {(1, 1): 2.0, (2, 1): 1.0, (2, 2): 5.0, (3, 1): 1.0, (1, 3): 4.0}
    points = []
    for image, (dx, dy) in enumerate([(0, 0), (3, 2)]):
        for y in range(8):
            for x in range(8):
                points.append((image, x, y, shape.get((x - dx, y - dy), 0.0)))
    df = spark.createDataFrame(points, "image_id int, x int, y int, v double")
    a, b = pixels.pixel_hu_moments(df).orderBy("image_id").collect()
    assert list(a)[1:] == pytest.approx(list(b)[1:])
    stats = pixels.pixel_stats(df).first()
    assert (stats.image_x, stats.image_y) == (8.0, 8.0)
    line = spark.createDataFrame([(0, x, 0, 1.0) for x in range(5)], "image_id int, x int, y int, v double")
    inertia = pixels.pixel_inertia(line).first()
    assert inertia[1] == pytest.approx(2.0) and inertia[2] == 0.0
    assert pixels.pixel_entropy(line).first().image_entropy == 0.0
