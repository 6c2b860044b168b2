"""The driver tables projected onto the engine's input schemas, in SQL both Spark and DuckDB run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.operators.pixels import explode_pixels
from seriesloom.roles import HEADER_TAGS

INSTANCES = r"""
SELECT event_id AS instance_id,
  concat('P', cast(user_id % 10 AS string)) AS patient_id,
  concat('ST', cast(user_id AS string)) AS study_uid,
  concat('SE', cast(user_id AS string), '.', cast(event_id % 3 AS string)) AS series_uid,
  CASE WHEN event_id % 17 = 0 THEN NULL
       WHEN event_id % 13 = 0 THEN 'nan'
       WHEN event_id % 7 = 0 THEN concat('ORIGINAL', chr(92), 'PRIMARY')
       WHEN event_type = 'error' THEN 'DERIVED;ADC'
       ELSE upper(event_type) END AS image_type,
  CASE (user_id + event_id % 3) % 6
       WHEN 0 THEN 't2 tse tra' WHEN 1 THEN 'T2 TSE SAG' WHEN 2 THEN 'ep2d_diff ADC'
       WHEN 3 THEN '  Ax DWI b800 ' WHEN 4 THEN 'dce 12/01/2020 dyn' ELSE '' END AS series_description,
  CASE user_id % 3 WHEN 0 THEN 'SIEMENS' WHEN 1 THEN 'GE MEDICAL SYSTEMS' ELSE 'Philips' END AS manufacturer,
  CASE WHEN user_id % 4 = 0 THEN '-' ELSE cast((event_id % 4) * 400 AS string) END AS diffusion_bvalue,
  CASE WHEN user_id % 8 = 0 THEN concat('100000', lpad(cast((event_id % 3) * 50 AS string), 4, '0')) ELSE '-' END AS diffusion_bvalue_ge,
  CASE WHEN user_id % 8 = 4 THEN cast((event_id % 2) * 1000 AS string) ELSE '-' END AS diffusion_bvalue_siemens,
  CASE WHEN event_id % 29 = 0 THEN ''
       WHEN event_id % 31 = 0 THEN concat(regexp_extract(props, '[0-9]+', 0), '  x')
       ELSE concat(regexp_extract(props, '[0-9]+', 0), ' ', cast(event_id % 5 AS string)) END AS echo_time,
  cast(event_id % 9 + 1 AS int) AS number_of_images,
  CASE WHEN event_id % 41 = 0 THEN '1.2.840.10008.5.1.4.1.1.66.4' ELSE '1.2.840.10008.5.1.4.1.1.4' END AS sop_class,
  event_id % 43 <> 0 AS valid,
  value AS image_mean
FROM {events}
"""

# The same schema from orders and their lines, with all header columns: a study per customer, a series per order.
_LI_COLUMNS = (
    "image_type series_description manufacturer diffusion_bvalue diffusion_bvalue_ge diffusion_bvalue_siemens echo_time "
    "repetition_time manufacturer_model_name"
).split()
# The columns without a rule of their own: three of five are the study's, one the series', one the instance's.
LI_REST = [c for c in HEADER_TAGS if c not in (*_LI_COLUMNS, "study_uid", "series_uid")]
_LI_REST = "".join(
    f",\n  concat('{c[0]}', cast(({('o_custkey', 'o_custkey', 'o_custkey', 'l_orderkey', 'l_suppkey')[i % 5]} * {i + 3}) % {i + 4} AS string)) AS {c}"
    for i, c in enumerate(LI_REST)
)
INSTANCES_LI = r"""
SELECT cast(l_orderkey * 10 + l_linenumber AS bigint) AS instance_id,
  concat('P', cast(o_custkey % 1000 AS string)) AS patient_id,
  concat('ST', cast(o_custkey AS string)) AS study_uid,
  concat('SE', cast(l_orderkey AS string)) AS series_uid,
  CASE WHEN l_linenumber % 7 = 0 THEN NULL
       WHEN l_returnflag = 'R' THEN 'DERIVED;ADC'
       WHEN l_returnflag = 'A' THEN concat('ORIGINAL', chr(92), 'PRIMARY')
       ELSE 'nan' END AS image_type,
  CASE l_orderkey % 6
       WHEN 0 THEN 't2 tse tra' WHEN 1 THEN 'T2 TSE SAG' WHEN 2 THEN 'ep2d_diff ADC'
       WHEN 3 THEN '  Ax DWI b800 ' WHEN 4 THEN 'dce 12/01/2020 dyn' ELSE '' END AS series_description,
  CASE o_custkey % 3 WHEN 0 THEN 'SIEMENS' WHEN 1 THEN 'GE MEDICAL SYSTEMS' ELSE 'Philips' END AS manufacturer,
  CASE WHEN l_suppkey % 4 = 0 THEN '-' ELSE cast((l_suppkey % 4) * 400 AS string) END AS diffusion_bvalue,
  '-' AS diffusion_bvalue_ge,
  CASE WHEN o_custkey % 3 = 0 THEN cast((l_suppkey % 2) * 1000 AS string) ELSE '-' END AS diffusion_bvalue_siemens,
  concat(cast(cast(l_quantity AS int) AS string), ' ', cast(l_linenumber AS string)) AS echo_time,
  cast(l_partkey % 500 AS string) AS repetition_time,
  o_orderpriority AS manufacturer_model_name,
  cast(l_linenumber AS int) AS number_of_images,
  l_extendedprice AS image_mean""" + _LI_REST + """
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
"""

VOTES = """
SELECT vec_id AS row_id, f.fold AS fold, cast(label % 5 AS int) AS y_true,
  cast(CASE WHEN (vec_id * 7 + f.fold * 3) % 5 = 0 THEN (label + 1 + f.fold) % 5 ELSE label % 5 END AS int) AS y_pred
FROM {embeddings} CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS f(fold)
"""

SCORES = """
SELECT vec_id AS row_id, cast(label % 5 AS int) AS y_true, c.cls AS cls,
  ((vec_id * 31 + c.cls * 13) % 97) / 97e0 + CASE WHEN label % 5 = c.cls THEN 5e-1 ELSE 0e0 END AS score
FROM {embeddings} CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS c(cls)
"""

PIXELS_DUCKDB = """
SELECT vec_id AS image_id, pos % 8 AS x, cast(floor(pos / 8) AS int) AS y, abs(cast(v AS double)) AS v
FROM (SELECT vec_id, unnest(embedding) AS v, cast(generate_subscripts(embedding, 1) - 1 AS int) AS pos FROM {embeddings})
"""

TAGS = """
SELECT instance_id, study_uid, series_uid,
  concat('{{"0020000D":{{"vr":"UI","Value":["', study_uid, '"]}},"0020000E":{{"vr":"UI","Value":["', series_uid,
         '"]}},"0008103E":{{"vr":"LO","Value":["', series_description,
         '"]}},"00080016":{{"vr":"UI","Value":["', sop_class,
         '"]}},"00189087":{{"vr":"FD","Value":["', diffusion_bvalue, '"]}},',
         '"00180081":{{"vr":"DS","Value":["', echo_time, '",', cast(instance_id % 7 AS string), ']}},"00180082":{{"vr":"DS"}}}}') AS tags
FROM {v_instances}
"""

VENDOR_TAGS = """
SELECT instance_id,
  concat('{{"0020000D":{{"vr":"UI","Value":["', study_uid, '"]}},"0020000E":{{"vr":"UI","Value":["', series_uid,
         '"]}},"0008103E":{{"Value":["', series_description, '"]}},"00080070":{{"Value":["', manufacturer,
         '"]}},"00080016":{{"Value":["', sop_class, '"]}},"00189087":{{"Value":["', diffusion_bvalue,
         '"]}},"00431039":{{"Value":["', diffusion_bvalue_ge, '"]}},"0019100C":{{"Value":["', diffusion_bvalue_siemens, '"]}}}}') AS tags
FROM {v_instances}
"""

ARCHIVE_TAGS = r"""
SELECT instance_id, study_uid, series_uid,
  concat('{{"0020,000d":{{"Name":"a","Type":"String","Value":"', study_uid, '"}},"0020,000E":{{"Value":"', series_uid,
         '"}},"0008,103e":{{"Value":"', series_description, '"}},"0019,100c":{{"Value":"', diffusion_bvalue_siemens,
         '"}},"0018,0081":{{"Value":"', replace(echo_time, ' ', concat(chr(92), chr(92))), '"}},"0018,0082":{{"Value":null}}}}') AS tags
FROM {v_instances}
"""

_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    return spark.sql(sql, **tables)


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, INSTANCES, events=table(spark, sf_dir, "events"))


def instances_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(
        spark,
        INSTANCES_LI,
        lineitem=table(spark, sf_dir, "lineitem"),
        orders=table(spark, sf_dir, "orders"),
    )


def _times_five(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    five = F.explode(F.array(*[F.lit(i) for i in range(5)])).alias(name)
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", five)


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = "(vec_id * 7 + fold * 3) % 5 = 0"
    return _times_five(spark, sf_dir, "fold").selectExpr(
        "vec_id AS row_id",
        "fold",
        "cast(label % 5 AS int) AS y_true",
        f"cast(CASE WHEN {changed} THEN (label + 1 + fold) % 5 ELSE label % 5 END AS int) AS y_pred",
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _times_five(spark, sf_dir, "cls").selectExpr(
        "vec_id AS row_id",
        "cast(label % 5 AS int) AS y_true",
        "cls",
        "((vec_id * 31 + cls * 13) % 97) / 97e0 + CASE WHEN label % 5 = cls THEN 5e-1 ELSE 0e0 END AS score",
    )


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, pixels): the vectors as 8 × 8 images of non-negative values."""
    values = F.transform("embedding", lambda v: F.abs(v.cast("double"))).alias("pixels")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), values)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_pixels(images(spark, sf_dir), "image_id", "pixels", 8)


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, TAGS, v_instances=instances(spark, sf_dir))


def vendor_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag documents with the maker and every b-value."""
    return _view(spark, VENDOR_TAGS, v_instances=instances(spark, sf_dir))


def archive_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, ARCHIVE_TAGS, v_instances=instances(spark, sf_dir))


_VIEW_SQL = {
    "v_instances": INSTANCES,
    "v_instances_li": INSTANCES_LI,
    "v_votes": VOTES,
    "v_scores": SCORES,
    "v_pixels": PIXELS_DUCKDB,
    "v_tags": TAGS,
    "v_archive_tags": ARCHIVE_TAGS,
}


def oracle(select: str, *views: str, **extra: str) -> str:
    """DuckDB statement: the named views and further CTEs in front of ``select``."""
    names = {name: name for name in (*_TABLES, *_VIEW_SQL)}
    ctes = [f"{name} AS ({_VIEW_SQL[name].format(**names)})" for name in views]
    ctes += [f"{name} AS ({sql})" for name, sql in extra.items()]
    return f"WITH {', '.join(ctes)} {select}" if ctes else select
