"""Sources and sinks: write to the shared scratch folder, read back, compare with the source rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views
from catalog.groups import _PAIRS, DISPLAY, summarise_sql
from catalog.registry import query
from catalog.rows import sanitize_sql
from catalog.scalars import strip_sql
from seriesloom.operators import metrics
from seriesloom.operators.clean import with_validity
from seriesloom.plans import files, metadata
from seriesloom.plans.extract import write_features
from seriesloom.plans.train import load_training_table
from seriesloom.roles import HEADER_TAGS
from seriesloom.session import scratch_path
from seriesloom.sources import inventory, nested_json, tables, tags

_KEYS = ("patient_id", "study_uid", "series_uid")
_TEXT = (
    "diffusion_bvalue",
    "diffusion_bvalue_ge",
    "diffusion_bvalue_siemens",
    "echo_time",
    "image_type",
    "instance_id",
    "manufacturer",
    "number_of_images",
    "series_description",
)


def _strings(spark, sf_dir):
    df = views.instances(spark, sf_dir)
    return df.select(*_KEYS, *[F.col(c).cast("string").alias(c) for c in _TEXT])


_STRINGS_SQL = f"SELECT {', '.join(_KEYS)}, {', '.join(f'cast({c} AS varchar) AS {c}' for c in _TEXT)} FROM v_instances"


def _round_trip(spark, df, suffix):
    path = scratch_path(spark, "table") + suffix
    tables.write_table(df, path)
    return path


@query("scan_delimited", views.oracle(_STRINGS_SQL, "v_instances"))
def scan_delimited(spark, sf_dir):
    spaced = _strings(spark, sf_dir).withColumnsRenamed({"echo_time": "echo time", "image_type": "image type"})
    return tables.scan_delimited(spark, _round_trip(spark, spaced, ".csv"))


@query("sink_delimited", views.oracle(_STRINGS_SQL, "v_instances"))
def sink_delimited(spark, sf_dir):
    path = _round_trip(spark, _strings(spark, sf_dir), ".tsv")
    return tables.scan_delimited(spark, path, columns=[*_KEYS, *_TEXT])


@query("scan_parquet", views.oracle(_STRINGS_SQL, "v_instances"))
def scan_parquet(spark, sf_dir):
    spaced = _strings(spark, sf_dir).withColumnRenamed("echo_time", "echo time")
    return tables.scan_parquet(spark, _round_trip(spark, spaced, ".parquet"))


@query(
    "sink_features_parquet",
    views.oracle(
        """SELECT instance_id, study_uid, series_uid FROM v_instances
        WHERE valid AND sop_class <> '1.2.840.10008.5.1.4.1.1.66.4'""",
        "v_instances",
    ),
)
def sink_features_parquet(spark, sf_dir):
    path = scratch_path(spark, "features") + ".parquet"
    write_features(with_validity(views.instances(spark, sf_dir), readable="valid"), path)
    return tables.scan_parquet(spark, path).select("instance_id", "study_uid", "series_uid")


@query("sink_nested_json", views.oracle(_STRINGS_SQL, "v_instances"))
def sink_nested_json(spark, sf_dir):
    path = scratch_path(spark, "documents") + ".json"
    documents = nested_json.to_documents(_strings(spark, sf_dir), _TEXT, "instance_id", instances_per_document=20)
    nested_json.write_documents(documents, path)
    return nested_json.scan_nested_json(spark, path, _TEXT)


_DOCUMENTS = """SELECT concat('{{"P', user_id, '":{{"ST', event_id, '":{{"SE":{{"echo_time":["', user_id, '","', event_id,
    '",null],"kind":"', event_type, '","flip_angle":["', event_id, '"],"number":[1,2.5]}}}}}}}}') AS document FROM {events}"""


@query(
    "scan_nested_json",
    """SELECT concat('P', user_id) AS patient_id, concat('ST', event_id) AS study_uid, 'SE' AS series_uid,
    [cast(user_id AS varchar), cast(event_id AS varchar), NULL][i] AS echo_time,
    [cast(event_id AS varchar)][i] AS flip_angle, event_type AS kind, ['1', '2.5'][i] AS number
    FROM events, (SELECT unnest([1, 2, 3]) AS i)""",
)
def scan_nested_json(spark, sf_dir):
    documents = spark.sql(_DOCUMENTS, events=views.table(spark, sf_dir, "events"))
    return nested_json.explode_documents(documents, "document")


@query(
    "scan_group_map",
    """SELECT concat('C', c_custkey) AS study_uid, c_mktsegment AS "group" FROM customer
    UNION ALL SELECT concat('N', c_custkey), cast(c_nationkey AS varchar) FROM customer""",
)
def scan_group_map(spark, sf_dir):
    path = scratch_path(spark, "groups")
    customers = views.table(spark, sf_dir, "customer").selectExpr(
        """concat('{"C', c_custkey, '": "', c_mktsegment, '", "N', c_custkey, '": "', c_nationkey, '"}') AS document"""
    )
    nested_json.write_documents(customers, path)
    return nested_json.scan_group_map(spark, path, whole_file=False)


_PARTS = "string_split(url, '/')"


@query(
    "scan_series_inventory",
    f"""SELECT *, count(*) OVER (PARTITION BY study_uid, series_uid) AS number_of_images FROM (
    SELECT CASE WHEN len(p) >= 3 THEN p[len(p) - 2] END AS study_uid, CASE WHEN len(p) >= 2 THEN p[len(p) - 1] END AS series_uid,
      p[len(p)] AS file_name, url AS file_path, page_id FROM (SELECT page_id, url, {_PARTS} AS p FROM pages))""",
)
def scan_series_inventory(spark, sf_dir):
    """The inventory of a listing that is a table: the paths of all pages."""
    return inventory.series_inventory(views.table(spark, sf_dir, "pages").select("page_id", "url"), "url", ["page_id"])


def _flat_sql(given: dict[str, str]) -> str:
    columns = [f"{given.get(name, chr(39) + '-' + chr(39))} AS {name}" for name in HEADER_TAGS]
    return views.oracle(f"SELECT instance_id, {', '.join(columns)} FROM v_instances", "v_instances")


@query(
    "flatten_tags_web",
    _flat_sql(
        {
            **{c: c for c in ("study_uid", "series_uid", "series_description", "diffusion_bvalue")},
            "echo_time": "concat(echo_time, ' ', cast(instance_id % 7 AS string))",
        }
    ),
)
def flatten_tags_web(spark, sf_dir):
    return tags.flatten_tags_web(views.tags(spark, sf_dir).select("instance_id", "tags"), keep=("instance_id",))


@query(
    "flatten_tags_archive",
    _flat_sql(
        {
            c: c
            for c in ("study_uid", "series_uid", "series_description", "diffusion_bvalue_siemens", "echo_time")
        }
    ),
)
def flatten_tags_archive(spark, sf_dir):
    documents = views.archive_tags(spark, sf_dir).select("instance_id", "tags")
    return tags.flatten_tags_archive(documents, keep=("instance_id",))


# broken documents among whole ones: no document, no JSON, no object, no ids, an empty id, one odd value
_BROKEN = """SELECT instance_id, CASE WHEN instance_id % 19 = 0 THEN NULL WHEN instance_id % 23 = 0 THEN 'not json'
      WHEN instance_id % 29 = 0 THEN '[1, 2]' WHEN instance_id % 31 = 0 THEN '{{}}'
      WHEN instance_id % 37 = 0 THEN '{{"0020000D":{{"Value":["x"]}},"0020000E":{{"Value":[" "]}}}}'
      WHEN instance_id % 41 = 0 THEN replace(tags, '"00180082":{{"vr":"DS"}}', '"00180082":"odd"') ELSE tags END AS tags FROM {tags}"""


@query(
    "rejected_tags",
    views.oracle(
        """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN instance_id % 19 = 0 THEN 'no document'
          WHEN instance_id % 23 = 0 OR instance_id % 29 = 0 THEN 'not a tag document'
          WHEN instance_id % 31 = 0 THEN 'no study_uid' WHEN instance_id % 37 = 0 THEN 'no series_uid' ELSE 'accepted' END AS reason
        FROM v_instances) GROUP BY reason""",
        "v_instances",
    ),
)
def rejected_tags(spark, sf_dir):
    """How many documents are taken, and how many are left out for which reason."""
    documents = spark.sql(_BROKEN, tags=views.tags(spark, sf_dir))
    rejected = tags.rejected_tags(documents, keep=("instance_id",)).select("reason")
    accepted = tags.flatten_tags_web(documents, keep=("instance_id",), need=tags.IDENTITY).select(F.lit("accepted").alias("reason"))
    return rejected.union(accepted).groupBy("reason").agg(F.count("*").alias("n"))


def _top(number: str, source: str, applies: str) -> str:
    keys = "PARTITION BY study_uid, series_uid"
    return f"""SELECT * EXCLUDE (applies, top) FROM (SELECT *, {applies} AS applies, max({number}) OVER ({keys}) AS top FROM {source})
        WHERE NOT applies OR {number} = top"""


_MAKER = "lower(first_value(manufacturer) OVER (PARTITION BY study_uid, series_uid ORDER BY instance_id))"
_METADATA = ("instance_id", "manufacturer", "diffusion_bvalue", "diffusion_bvalue_ge", "diffusion_bvalue_siemens", "series_description")


@query(
    "metadata_documents",
    views.oracle(
        """SELECT patient_id, study_uid, series_uid, manufacturer, diffusion_bvalue, diffusion_bvalue_ge, diffusion_bvalue_siemens,
          series_description, cast(instance_id AS varchar) AS instance_id,
          row_number() OVER (PARTITION BY patient_id, study_uid, series_uid ORDER BY instance_id) - 1 AS place FROM third""",
        "v_instances",
        images=rf"""SELECT instance_id, concat('P', right(study_uid, 1)) AS patient_id, study_uid, series_uid, manufacturer, diffusion_bvalue,
            CASE WHEN length(diffusion_bvalue_ge) > 5 THEN ltrim(right(diffusion_bvalue_ge, 4), '0') ELSE diffusion_bvalue_ge END AS diffusion_bvalue_ge,
            CASE instance_id % 3 WHEN 0 THEN cast(instance_id % 200 AS varchar) ELSE diffusion_bvalue_siemens END AS diffusion_bvalue_siemens,
            {strip_sql("series_description")} AS series_description
          FROM v_instances WHERE sop_class <> '1.2.840.10008.5.1.4.1.1.66.4'""",
        first=_top("CASE WHEN diffusion_bvalue = '-' THEN -1 ELSE cast(diffusion_bvalue AS double) END", "images", "true"),
        second=_top(
            "CASE WHEN diffusion_bvalue_siemens = '-' THEN -1 ELSE cast(diffusion_bvalue_siemens AS double) END",
            "first",
            f"{_MAKER} LIKE '%siemens%'",
        ),
        third=_top(
            "CASE WHEN diffusion_bvalue_ge = '-' THEN -1 ELSE try_cast(diffusion_bvalue_ge AS double) END",
            "second",
            f"""{_MAKER} LIKE '%ge med%' AND NOT bool_or(diffusion_bvalue_ge <> '-' AND try_cast(diffusion_bvalue_ge AS double) IS NULL)
                OVER (PARTITION BY study_uid, series_uid)""",
        ),
    ),
)
def metadata_documents(spark, sf_dir):
    """Tag documents to metadata documents, written and read back with every row's place in its series."""
    number = F.col("instance_id")
    # big-endian bytes of a small number, of one beyond any b-value, or none
    credible = F.unhex(F.lpad(F.hex(number % 200), 4, "0"))
    raw = F.when(number % 3 == 0, credible).when(number % 3 == 1, F.unhex(F.lit("FFFFFF")))
    documents = views.vendor_tags(spark, sf_dir).withColumn("bytes", raw)
    patient = F.concat(F.lit("P"), F.right("study_uid", F.lit(1)))
    out = metadata.metadata_documents(
        documents, "instance_id", patient=patient, raw={"diffusion_bvalue_siemens": "bytes"}, features=_METADATA, instances_per_document=20
    )
    path = scratch_path(spark, "metadata") + ".json"
    nested_json.write_documents(out, path)
    return nested_json.scan_nested_json(spark, path, _METADATA, position="place")


@query(
    "assemble_study",
    views.oracle(
        """SELECT instance_id, study_uid, series_uid, study_uid AS patient_id,
        regexp_replace(series_description, '[0-9]+/[0-9]+/[0-9]+', '', 'g') AS series_description,
        count(*) OVER (PARTITION BY study_uid, series_uid) AS number_of_images FROM v_instances""",
        "v_instances",
    ),
)
def assemble_study(spark, sf_dir):
    flat = tags.flatten_tags_web(views.tags(spark, sf_dir).select("instance_id", "tags"), keep=("instance_id",))
    return tags.assemble_study(flat).select(
        "instance_id", "study_uid", "series_uid", "patient_id", "series_description", "number_of_images"
    )


_TYPED = ("image_type", "series_description", "manufacturer", "diffusion_bvalue", "diffusion_bvalue_ge", "diffusion_bvalue_siemens", "echo_time", "sop_class", "valid")
_FOLDED = [c for c in _TEXT if c not in ("number_of_images", "instance_id")]


@query(
    "read_any",
    views.oracle(
        summarise_sql(("study_uid", "series_uid", "patient_id"), [*_FOLDED, "sop_uid"], "named", None),
        "v_instances",
        named="SELECT * RENAME (instance_id AS sop_uid) FROM v_instances",
    ),
)
def read_any(spark, sf_dir):
    rows = _strings(spark, sf_dir)
    third = F.pmod(F.col("instance_id").cast("bigint"), F.lit(3))
    documents = scratch_path(spark, "part") + ".json"
    nested_json.write_documents(
        nested_json.to_documents(rows.filter(third == 2), _TEXT, "instance_id"), documents
    )
    paths = [
        documents,
        _round_trip(spark, rows.filter(third == 1), ".parquet"),
        _round_trip(spark, rows.filter(third == 0), ".csv"),
    ]
    return tables.read_any(spark, paths, mapping=["instance_id:sop_uid"])


@query(
    "read_any_typed",
    views.oracle(
        summarise_sql(
            ("study_uid", "series_uid", "patient_id"), _TYPED, "v_instances", "round(avg(image_mean), 9) AS image_mean"
        ),
        "v_instances",
    ),
)
def read_any_typed(spark, sf_dir):
    """Parquet tables only: cells keep their types, so image features and counts are numbers from the start."""
    rows = views.instances(spark, sf_dir)
    paths = [_round_trip(spark, rows.filter(part).drop("instance_id"), ".parquet") for part in ("instance_id % 2 = 0", "instance_id % 2 = 1")]
    return tables.read_any(spark, paths).withColumn("image_mean", F.round("image_mean", 9))


_ORDERED = "md5(concat_ws('|', study_uid, '42')), study_uid"


@query(
    "split_files",
    views.oracle(
        f"""SELECT instance_id, study_uid, CASE WHEN r <= floor(0.75 * n) THEN 'a' ELSE 'b' END AS part FROM (
          SELECT CAST(instance_id AS varchar) AS instance_id, study_uid FROM v_instances) JOIN (
          SELECT study_uid, row_number() OVER (ORDER BY {_ORDERED}) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT study_uid FROM v_instances))
        USING (study_uid)""",
        "v_instances",
    ),
)
def split_files(spark, sf_dir):
    """A table in a file to two files without a study in common, read back."""
    source = _round_trip(spark, _strings(spark, sf_dir), ".tsv")
    outputs = [scratch_path(spark, "part") + suffix for suffix in (".parquet", ".csv")]
    files.split_files(spark, source, outputs, 0.75, "study_uid")
    a, b = tables.scan_parquet(spark, outputs[0]), tables.scan_delimited(spark, outputs[1])
    both = a.withColumn("part", F.lit("a")).unionByName(b.withColumn("part", F.lit("b")))
    return both.select("instance_id", "study_uid", "part")


@query(
    "merge_target_files",
    """SELECT CAST(d.doc_id AS varchar) AS doc_id, lang, CAST(quality AS varchar) AS class FROM documents d JOIN labels USING (doc_id)
    WHERE quality IS NOT NULL""",
)
def merge_target_files(spark, sf_dir):
    documents = views.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "lang")
    labels = views.table(spark, sf_dir, "labels").where("quality is not null")
    labels = labels.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("quality").cast("string").alias("class"), "toxic")
    paths = _round_trip(spark, documents, ".csv"), _round_trip(spark, labels.select("doc_id", "class"), ".tsv")
    return files.merge_target_files(spark, *paths, ["doc_id"], scratch_path(spark, "merged") + ".parquet")


@query(
    "sink_metrics",
    views.oracle(
        """SELECT "true", pred, cast(count(row_id) AS varchar) AS n FROM pairs
        LEFT JOIN v_votes ON y_true = t AND y_pred = p GROUP BY "true", pred""",
        "v_votes",
        pairs=_PAIRS,
    ),
)
def sink_metrics(spark, sf_dir):
    table = metrics.confusion_matrix(views.votes(spark, sf_dir), DISPLAY)
    return tables.scan_delimited(spark, _round_trip(spark, table, ".csv"))



@query(
    "load_training_table",
    views.oracle(
        sanitize_sql(
            "exact",
            "v_instances",
            ("study_uid", "series_uid", "lower(image_type) AS class", "image_type", "manufacturer", "echo_time", "number_of_images"),
        ),
        "v_instances",
    ),
)
def training_table(spark, sf_dir):
    df = views.instances(spark, sf_dir).select(
        "study_uid",
        "series_uid",
        F.col("image_type").alias("class"),
        "image_type",
        "manufacturer",
        "echo_time",
        "number_of_images",
        "valid",
        F.lit("x").alias("inversion_time"),
    )
    path = scratch_path(spark, "training") + ".parquet"
    tables.write_table(df, path)
    return load_training_table(spark, path)
