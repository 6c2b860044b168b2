"""Folding by header combinations, n-grams by levels, images in the row, votes in one pass: results and plans."""

import threading

import pytest
from pyspark.sql import functions as F

from seriesloom.functions.ngrams import placed_words, word_ngrams, word_tokens
from seriesloom.operators import features, models, pixels, summarise
from seriesloom.operators.clean import filter_max_bvalue
from seriesloom.roles import HEADER_TAGS
from seriesloom.sources import inventory, nested_json, tags


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def wide(spark):
    """All header columns; a third of the rows is one series, ids are NULL for some, cells NULL, ``nan`` or with marks."""
    rows = spark.range(3000)
    series = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 101 == 1, None).otherwise(F.concat(F.lit("s"), (F.col("id") % 50).cast("string")))
    cells = {
        c: F.when(F.col("id") % (7 + i) == 0, None).when(F.col("id") % (11 + i) == 0, "nan").otherwise(F.concat(F.lit("a\\"), (F.col("id") % (2 + i % 5)).cast("string")))
        for i, c in enumerate(c for c in HEADER_TAGS if c not in ("study_uid", "series_uid"))
    }
    return rows.select(
        F.lit("st").alias("study_uid"), series.alias("series_uid"), F.lit("p").alias("patient_id"), F.col("id").alias("row"),
        *[v.alias(c) for c, v in cells.items()], (F.col("id") % 4).alias("number_of_images"), (F.col("id") % 10).alias("image_mean"),
    )


def test_both_ways_of_folding_agree(wide):
    one = {r.series_uid: r for r in summarise.summarise(wide, large=False).collect()}
    other = {r.series_uid: r for r in summarise.summarise(wide, large=True).collect()}
    assert one == other and len(one) == 52
    assert summarise.has_large_group(wide, ["study_uid", "series_uid"], 900) and not summarise.has_large_group(wide, ["study_uid", "series_uid"], 1000)
    assert one["hot"].echo_time == "- a-0 a-1 a-2" or set(one["hot"].echo_time.split(" ")) >= {"-", "a-0"}
    few = summarise.summarise(wide, columns=["echo_time", "image_mean"], large=False)
    assert few.columns == ["study_uid", "series_uid", "patient_id", "echo_time", "image_mean", "number_of_images"]
    assert {r.series_uid: r.echo_time for r in few.collect()} == {k: r.echo_time for k, r in one.items()}
    plan = plan_of(summarise.summarise(wide, large=False))
    assert plan.count("Exchange") == 1 and plan.count("collect_set") <= 4  # one set, partial and final


def test_max_bvalue_reads_the_table_twice(spark):
    rows = [("a", "s", "0", "SIEMENS", "100"), ("a", "s", "800", "SIEMENS", "100"), ("a", "s", "800", "SIEMENS", "50"), ("a", "t", "x", "GE", "-"), ("a", "t", "5", "GE", "-"), (None, "u", "-", None, "-"), (None, "u", "1", None, None)]
    df = spark.createDataFrame(rows, "study_uid string, series_uid string, diffusion_bvalue string, manufacturer string, diffusion_bvalue_siemens string")
    df = df.withColumn("diffusion_bvalue_ge", F.lit("-"))
    kept = filter_max_bvalue(df)
    got = sorted((r.series_uid, r.diffusion_bvalue, r.diffusion_bvalue_siemens) for r in kept.select("series_uid", "diffusion_bvalue", F.coalesce("diffusion_bvalue_siemens", F.lit("none")).alias("diffusion_bvalue_siemens")).collect())
    assert got == [("s", "800", "100"), ("t", "5", "-"), ("t", "x", "-"), ("u", "1", "none")]
    plan = plan_of(filter_max_bvalue(df))
    assert plan[: plan.index("Initial Plan") if "Initial Plan" in plan else None].count("Scan ExistingRDD") == 2 and "Window" not in plan


def test_ngrams_are_mined_by_level(spark):
    texts = ["t2 tse tra"] * 4 + ["t2 tse sag", "tse tra", "t2", "", None, "one two three four five six", "t2 tse tra t2 tse tra"]
    df = spark.createDataFrame([(t, "x") for t in texts], "series_description string, other string")
    columns = ["series_description", "other"]
    direct = (
        df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(c, F.lit("")).alias("text")) for c in columns])).alias("c"))
        .select("c.column", F.explode(word_ngrams(word_tokens(F.col("c.text")), 5)).alias("term"))
        .groupBy("column", "term").agg(F.count("*").alias("n"))
    )
    for share in (0.01, 0.2, 0.45):
        want = {(r["column"], r.term, r.n) for r in direct.collect() if r.n >= share * len(texts)}
        got = {(r["column"], r.term, r.n_rows) for r in features.text_counts(df, columns, share).collect()}
        assert got == want
    # of the pairs only those of frequent words are counted, and so on: no row of the long rare text is shuffled
    state = spark.createDataFrame([("c", 1, t) for t in texts if t], "column string, n long, text string")
    state = state.select("column", "n", placed_words(word_tokens("text")).alias("grams"))
    frequent = features.count_grams(state).where("n_rows >= 4")
    pairs = features.extend_grams(state, features._frequent_marks(frequent))
    assert {r.term for r in features.count_grams(pairs).collect()} == {"t2 tse", "tse tra", "tra t2"}
    assert pairs.where("exists(grams, g -> g.gram like 'one%')").count() == 0


def test_images_stay_in_their_rows(spark):
    images = spark.createDataFrame(
        [(1, [float(i % 7) for i in range(12)], "m"), (2, [3.0] * 12, "m"), (3, [], "m"), (4, None, "m"), (5, [1.0, None, 5.0, 2.5] * 3, "m")],
        "image_id long, pixels array<double>, m00 string",
    )
    rows = pixels.explode_pixels(images, "image_id", "pixels", 4)
    made = {
        "stats": (pixels.with_stats(images, "pixels", 4), pixels.pixel_stats(rows)),
        "entropy": (pixels.with_entropy(images, "pixels"), pixels.pixel_entropy(rows.where("v is not null"))),
        "hu": (pixels.with_hu_moments(images, "pixels", 4), pixels.pixel_hu_moments(rows)),
        "corner": (pixels.with_hu_moments(images, "pixels", 4, "corner"), pixels.pixel_hu_moments(rows, of="corner")),
        "inertia": (pixels.with_inertia(images, "pixels", 4), pixels.pixel_inertia(rows)),
    }
    for name, (array, exploded) in made.items():
        assert "Exchange" not in plan_of(array) and "Generate" not in plan_of(array), name
        assert array.columns[:3] == images.columns
        got = {r.image_id: r for r in array.collect()}
        assert set(got) == {1, 2, 3, 4, 5}
        for want in exploded.collect():
            for c in exploded.columns[1:]:
                x, y = got[want.image_id][c], want[c]
                assert (x is None or x != x) == (y is None or y != y), (name, c, want.image_id, x, y)
                assert x is None or y is None or x != x or abs(x - y) < 1e-9, (name, c, want.image_id, x, y)
        assert all(got[i][c] is None for i in (3, 4) for c in array.columns[3:] if name in ("stats", "entropy"))


def test_votes_of_all_variants_come_from_one_pass(spark):
    votes = spark.createDataFrame(
        [("", 1, "a", "a"), ("", 2, "a", "a"), ("", 3, "b", "b"), ("x", 1, "a", "b"), ("x", 2, "a", "a"), ("x", 3, "b", "b"), ("y", 1, "a", None), ("y", 2, "a", "a"), ("y", 3, "b", "a")],
        "variant string, row int, y_true string, y_pred string",
    )
    got = {(r["class"], r.feature): r.value for r in models.importance_of(votes).collect()}
    assert got == {("a", "x"): 0.5, ("a", "y"): 0.5, ("b", "x"): 0.0, ("b", "y"): 1.0}
    assert plan_of(models.importance_of(votes)).count("Scan") == 1


def test_boosting_names_draw_their_own_parameters():
    drawn = {name: models.draw_params("classification", name, 20, 1) for name in ("xgb", "lgb", "catboost")}
    assert [set(d[0]) for d in drawn.values()] == [
        {"stepSize", "maxDepth", "minInstancesPerNode", "minInfoGain"}, {"maxDepth", "stepSize", "maxIter"}, {"maxBins", "maxDepth", "stepSize"}
    ]
    assert all(0.01 <= p["stepSize"] <= 0.1 and 10 <= p["maxIter"] < 100 for p in drawn["lgb"])
    _, lgb = models.make_estimator("regression", "lgb", {}, 1)
    _, cat = models.make_estimator("regression", "catboost", {}, 1)
    assert (lgb.getMaxIter(), cat.getMaxIter()) == (100, 1000) and cat.getOrDefault("validationIndicatorCol") == models.HELD_BACK


def test_boosting_stops_when_nothing_is_gained(spark):
    rows = spark.range(400).select(
        F.concat(F.lit("st"), (F.col("id") % 100).cast("string")).alias("study_uid"), F.col("id").cast("string").alias("series_uid"),
        F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("manufacturer"), (F.col("id") % 2).cast("double").alias("image_mean"),
    )
    spec = models.TrainSpec(target="image_mean", task="regression", model="catboost", params=(("maxIter", 200), ("stepSize", 0.5)))
    spec = models.replace(spec, roles=spec.roles.restricted(include=["manufacturer"]))
    model = models.fit_model(models.prepare(rows, spec, ()), spec, ())
    assert model.pipeline.stages[-1].getNumTrees < 50


def test_folds_are_fitted_side_by_side(spark):
    spark.sparkContext.setLocalProperty("spark.scheduler.pool", "folds")
    both = threading.Barrier(2, timeout=60)  # passed only if two run at a time

    def work(i):
        both.wait()
        return i, spark.sparkContext.getLocalProperty("spark.scheduler.pool"), spark.range(10).count()

    try:
        assert models.in_parallel(work, [1, 2], 2) == [(1, "folds", 10), (2, "folds", 10)]
    finally:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)


def test_documents_that_are_none_are_told_apart(spark):
    good = '{"0020000D":{"Value":["st"]},"0020000E":{"Value":["se"]},"00180081":{"Value":[1,5]}}'
    rows = [(1, good), (2, None), (3, "not json"), (4, "{}"), (5, '{"0020000D":{"Value":["st"]}}'), (6, good.replace("[1,5]", "7")), (7, "")]
    df = spark.createDataFrame(rows, "k int, tags string")
    flat = {r.k: r for r in tags.flatten_tags_web(df, keep=("k",), need=tags.IDENTITY).collect()}
    assert {r.k for r in tags.flatten_tags_web(df, keep=("k",)).collect()} >= {1, 4, 5, 6}
    assert set(flat) == {1, 6} and flat[1].echo_time == "1 5" and flat[6].series_uid == "se"
    bad = {r.k: r.reason for r in tags.rejected_tags(df, keep=("k",)).collect()}
    assert bad == {2: "no document", 3: "not a tag document", 4: "no study_uid", 5: "no series_uid", 7: bad[7]} and bad[7]
    archive = spark.createDataFrame([(1, '{"0020,000d":{"Value":"st"},"0020,000E":{"Value":"se"}}'), (2, "x"), (3, '{"0020,000d":{"Value":"st"}}')], "k int, tags string")
    assert [r.k for r in tags.flatten_tags_archive(archive, keep=("k",), need=tags.IDENTITY).collect()] == [1]
    assert {r.k: r.reason for r in tags.rejected_tags(archive, form="archive", keep=("k",)).collect()} == {2: "not a tag document", 3: "no series_uid"}
    assert len(tags.flatten_tags_web(df, keep=("k",), fault="why").collect()) == 7


def test_unreadable_documents_can_be_left_out(spark):
    df = spark.createDataFrame([('{"p":{"st":{"se":{"a":["1","2"]}}}}',), ("nonsense",), ("",), ('{"p": 3}',)], "document string")
    back = nested_json.explode_documents(df, "document", ["a"], position="at", unreadable="drop")
    assert sorted((r.a, r["at"]) for r in back.collect()) == [("1", 0), ("2", 1)]
    bad = {r.text: r.reason for r in nested_json.rejected_documents(df, "document").collect()}
    assert bad["nonsense"] == "not an object" and "" not in bad
    with pytest.raises(Exception, match="not a nested document"):
        nested_json.explode_documents(df, "document", ["a"]).collect()


def test_inventory_of_paths(spark):
    df = spark.createDataFrame([("/x/st/se/1.dcm",), ("/x/st/se/2.dcm",), ("lonely",), (None,)], "path string")
    got = sorted((tuple(r) for r in inventory.series_inventory(df).collect()), key=str)
    assert got == sorted(
        [("st", "se", "1.dcm", "/x/st/se/1.dcm", 2), ("st", "se", "2.dcm", "/x/st/se/2.dcm", 2), (None, None, "lonely", "lonely", 2), (None, None, None, None, 2)], key=str
    )


def test_wide_folds_run_as_compiled_code(spark):
    """A stage whose method is too long for the JVM's compiler is made of smaller ones; a session's own limit stays."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name, None)
    df = spark.createDataFrame([("s", "a"), ("s", "b")], "series_uid string, manufacturer string")
    try:
        spark.conf.unset(name)
        assert summarise.summarise(df).first().manufacturer == "a b"
        assert int(spark.conf.get(name)) == 8000
        spark.conf.set(name, "65535")
        summarise.summarise(df)
        assert spark.conf.get(name) == "65535"
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
