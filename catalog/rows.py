"""Renaming, cleaning, filters, joins and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views
from catalog.registry import query
from seriesloom.operators import clean, joins
from seriesloom.roles import DEFAULT_VALUES, NUMBER_TOKEN_COLUMNS, TEXT_COLUMNS

_COLUMNS = (
    "instance_id patient_id study_uid series_uid image_type series_description manufacturer diffusion_bvalue "
    "diffusion_bvalue_ge diffusion_bvalue_siemens echo_time number_of_images sop_class valid image_mean"
).split()


@query(
    "rename_columns",
    views.oracle(
        'SELECT instance_id AS sop_uid, manufacturer AS maker, study_uid AS "study_uid" FROM v_instances',
        "v_instances",
    ),
)
def rename_columns(spark, sf_dir):
    df = views.instances(spark, sf_dir).select("instance_id", "manufacturer", F.col("study_uid").alias("study uid"))
    return clean.rename_columns(clean.underscore_names(df), ["instance_id:sop_uid", "manufacturer:maker"])


@query(
    "role_project",
    views.oracle(
        """SELECT instance_id, image_type, manufacturer, diffusion_bvalue, diffusion_bvalue_ge,
        diffusion_bvalue_siemens, echo_time, number_of_images, image_mean FROM v_instances""",
        "v_instances",
    ),
)
def role_project(spark, sf_dir):
    return clean.role_project(
        views.instances(spark, sf_dir), exclude=["series_description"], keep=["instance_id"]
    )


def sanitize_sql(mode: str, source: str = "v_instances", columns=tuple(_COLUMNS)) -> str:
    out = []
    for name in columns:
        if name not in TEXT_COLUMNS and name not in NUMBER_TOKEN_COLUMNS:
            out.append(name)
            continue
        value = name
        if mode == "substring":
            value = f"translate({value}, '|-;,.()_:', '         ')"
        else:
            value = rf"CASE WHEN {value} IN ('\|', '\-', ';', ',', '\.', '\(', '\)', '_', ':') THEN ' ' ELSE {value} END"
        value = f"trim({value}, ' ')"
        if name in DEFAULT_VALUES:
            value = f"CASE WHEN {value} = '' THEN '{DEFAULT_VALUES[name]}' ELSE {value} END"
        out.append(f"lower({value}) AS {name}")
    return f"SELECT {', '.join(out)} FROM {source}"


@query("sanitize", views.oracle(sanitize_sql("exact"), "v_instances"))
def sanitize(spark, sf_dir):
    return clean.sanitize(views.instances(spark, sf_dir))


@query("sanitize_substring", views.oracle(sanitize_sql("substring"), "v_instances"))
def sanitize_substring(spark, sf_dir):
    return clean.sanitize(views.instances(spark, sf_dir), mode="substring")


@query(
    "filter_regex",
    views.oracle(
        """SELECT instance_id, series_description, manufacturer FROM v_instances
        WHERE regexp_matches(lower(series_description), 't2 .*sag|dwi')
        AND regexp_matches(lower(manufacturer), '^(siem|phil)')""",
        "v_instances",
    ),
)
def filter_regex(spark, sf_dir):
    df = views.instances(spark, sf_dir).select("instance_id", "series_description", "manufacturer")
    return clean.filter_regex(
        df, {"series_description": ["T2 .*SAG", "dwi"], "manufacturer": "^(Siem|Phil)"}
    )


@query(
    "filter_tags_exact",
    views.oracle(
        """SELECT instance_id, image_type, manufacturer FROM v_instances
        WHERE image_type IN ('CLICK', 'VIEW', 'nan') AND manufacturer = 'Philips'""",
        "v_instances",
    ),
)
def filter_tags_exact(spark, sf_dir):
    df = views.instances(spark, sf_dir).select("instance_id", "image_type", "manufacturer")
    return clean.filter_tags_exact(df, {"image_type": ["CLICK", "VIEW", "nan"], "manufacturer": "Philips"})


@query(
    "filter_valid",
    views.oracle(
        """SELECT instance_id, study_uid, valid, false AS seg FROM v_instances
        WHERE valid AND sop_class <> '1.2.840.10008.5.1.4.1.1.66.4'""",
        "v_instances",
    ),
)
def filter_valid(spark, sf_dir):
    flagged = clean.with_validity(views.instances(spark, sf_dir), readable="valid")
    return clean.filter_valid(flagged).select("instance_id", "study_uid", "valid", "seg")


def _number_sql(column: str) -> str:
    return f"CASE WHEN {column} = '-' THEN -1 ELSE try_cast({column} AS double) END"


def _vendor_pass(source: str, column: str, vendor: str | None) -> str:
    keys = "PARTITION BY study_uid, series_uid"
    maker = (
        f"lower(first_value(manufacturer) OVER ({keys} ORDER BY instance_id)) LIKE '%{vendor}%'"
        if vendor
        else "true"
    )
    number = _number_sql(column)
    return f"""SELECT * EXCLUDE (applies, top) FROM (SELECT *, {maker} AND NOT bool_or(({number}) IS NULL) OVER ({keys}) AS applies,
        max({number}) OVER ({keys}) AS top FROM {source}) WHERE NOT applies OR ({number}) = top"""


@query(
    "filter_max_bvalue",
    views.oracle(
        "SELECT instance_id, study_uid, series_uid, diffusion_bvalue, diffusion_bvalue_ge, diffusion_bvalue_siemens FROM third",
        "v_instances",
        first=_vendor_pass("v_instances", "diffusion_bvalue", None),
        second=_vendor_pass("first", "diffusion_bvalue_siemens", "siemens"),
        third=_vendor_pass("second", "diffusion_bvalue_ge", "ge med"),
    ),
)
def filter_max_bvalue(spark, sf_dir):
    kept = clean.filter_max_bvalue(views.instances(spark, sf_dir), order="instance_id")
    return kept.select(
        "instance_id", "study_uid", "series_uid", "diffusion_bvalue", "diffusion_bvalue_ge", "diffusion_bvalue_siemens"
    )


_HOLES = """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS a,
    CASE WHEN event_id % 4 = 0 THEN cast('nan' AS double) ELSE value END AS b,
    CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN cast('nan' AS double) ELSE value END AS c
    FROM {events}"""


@query(
    "drop_nan_rows",
    f"""SELECT event_id FROM ({_HOLES.format(events="events")}) WHERE
    cast(a IS NULL AS int) + cast(b IS NULL OR isnan(b) AS int) + cast(c IS NULL OR isnan(c) AS int) <= 1""",
)
def drop_nan_rows(spark, sf_dir):
    df = spark.sql(_HOLES, events=views.table(spark, sf_dir, "events"))
    return clean.drop_nan_rows(df, ["a", "b", "c"]).select("event_id")


@query(
    "clean_target_class",
    "SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' END AS class FROM labels",
)
def clean_target_class(spark, sf_dir):
    target = F.when(F.col("toxic") == 1, "TOXIC").when(F.col("quality") == 1, "Good")
    df = views.table(spark, sf_dir, "labels").select("doc_id", target.alias("class"))
    return clean.clean_target(df)


_TARGETS = """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'nan' WHEN event_id % 13 = 0 THEN 'inf'
    WHEN event_id % 17 = 0 THEN 'n/a' WHEN event_id % 19 = 0 THEN NULL
    ELSE regexp_extract(props, '[0-9]+', 0) END AS target FROM {events}"""


@query(
    "clean_target_numeric",
    f"""SELECT event_id, try_cast(target AS double) AS target FROM ({_TARGETS.format(events="events")})
    WHERE try_cast(target AS double) IS NOT NULL AND isfinite(try_cast(target AS double))""",
)
def clean_target_numeric(spark, sf_dir):
    df = spark.sql(_TARGETS, events=views.table(spark, sf_dir, "events"))
    return clean.clean_target(df, "target", "regression")


@query("filter_by_ids", "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def filter_by_ids(spark, sf_dir):
    documents = views.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return clean.filter_by_ids(documents, views.table(spark, sf_dir, "labels"), "doc_id")


@query(
    "filter_by_ids_complement",
    "SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def filter_by_ids_complement(spark, sf_dir):
    documents = views.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return clean.filter_by_ids(documents, views.table(spark, sf_dir, "labels"), "doc_id", keep=False)


@query(
    "feature_variances",
    """SELECT feature, round(variance, 4) AS variance, variance > 0 AS kept FROM (
    SELECT 'l_quantity' AS feature, var_pop(l_quantity) AS variance FROM lineitem
    UNION ALL SELECT 'l_discount', var_pop(l_discount) FROM lineitem
    UNION ALL SELECT 'constant', 0.0)""",
)
def feature_variances(spark, sf_dir):
    df = views.table(spark, sf_dir, "lineitem").withColumn("constant", F.lit(7))
    out = clean.feature_variances(df, ["l_quantity", "l_discount", "constant"])
    return out.withColumn("variance", F.round("variance", 4))


@query(
    "variance_filter",
    "SELECT l_orderkey, l_linenumber, 7 AS other_constant, l_quantity, l_discount FROM lineitem",
)
def variance_filter(spark, sf_dir):
    """The rows without the columns that never vary; one that is not asked about stays."""
    df = views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lit(7).alias("other_constant"), "l_quantity", "l_discount")
    flat = {"constant": F.lit(7), "unknown": F.lit(None).cast("double"), "nan_only": F.lit(float("nan"))}
    return clean.variance_filter(df.withColumns(flat), ["l_quantity", "l_discount", *flat])


@query(
    "merge_target",
    "SELECT d.doc_id, lang, source, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
)
def merge_target(spark, sf_dir):
    documents = views.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return joins.merge_target(documents, views.table(spark, sf_dir, "labels"), ["doc_id"], "quality")


@query(
    "join_group_map",
    """SELECT o_custkey AS study_uid, o_orderkey, c_mktsegment AS "group" FROM orders
    JOIN customer ON o_custkey = c_custkey WHERE c_nationkey < 20""",
)
def join_group_map(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("study_uid"), "o_orderkey")
    groups = (
        views.table(spark, sf_dir, "customer")
        .filter("c_nationkey < 20")
        .select(F.col("c_custkey").alias("study_uid"), F.col("c_mktsegment").alias("group"))
    )
    return joins.join_group_map(orders, groups)


_KNOWN = ("red_widget", "blue_anvils", "cold_gizm", "SmallRing", "hot_bolt", "echo_time", "large_gear")


@query(
    "fuzzy_match_names",
    f"""WITH scored AS (SELECT known, p_name AS candidate, 1 - levenshtein(known, plain) / greatest(length(known), length(plain)) AS s
        FROM (SELECT DISTINCT p_name, replace(p_name, ' ', '_') AS plain FROM part),
             (SELECT unnest([{', '.join(f"'{k}'" for k in _KNOWN)}]) AS known)),
    best AS (SELECT *, row_number() OVER (PARTITION BY known ORDER BY s DESC, candidate) AS r FROM scored)
    SELECT known, CASE WHEN s > 0.8 THEN candidate END AS candidate, round(s, 6) AS similarity FROM best WHERE r = 1""",
)
def fuzzy_match_names(spark, sf_dir):
    best = joins.fuzzy_match_names(views.table(spark, sf_dir, "part"), "p_name", _KNOWN)
    return best.withColumn("similarity", F.round("similarity", 6))


@query(
    "union_vertical",
    """SELECT o_orderkey AS k, o_orderstatus AS s FROM orders
    UNION ALL SELECT l_orderkey, l_linestatus FROM lineitem""",
)
def union_vertical(spark, sf_dir):
    return clean.union_vertical(
        [
            views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s")),
            views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linestatus").alias("s")),
        ]
    )


@query(
    "union_diagonal",
    """SELECT c_custkey AS k, c_name AS name, c_mktsegment AS segment, NULL::INTEGER AS nation FROM customer
    UNION ALL SELECT s_suppkey, s_name, NULL, s_nationkey FROM supplier""",
)
def union_diagonal(spark, sf_dir):
    customers = views.table(spark, sf_dir, "customer").selectExpr("c_custkey k", "c_name name", "c_mktsegment segment")
    suppliers = views.table(spark, sf_dir, "supplier").selectExpr("s_nationkey nation", "s_name name", "s_suppkey k")
    return clean.union_diagonal([customers, suppliers])


@query(
    "class_order",
    "SELECT DISTINCT event_type AS class, cast(dense_rank() OVER (ORDER BY event_type) - 1 AS int) AS class_index FROM events",
)
def class_order(spark, sf_dir):
    return clean.class_order(views.table(spark, sf_dir, "events").withColumnRenamed("event_type", "class"))
