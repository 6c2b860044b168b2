"""Column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views
from catalog.registry import query
from seriesloom.functions import bvalues, numbers, text
from seriesloom.operators.features import text_counts
from seriesloom.operators.rules import resolved_bvalue

_STRIP = "regexp_replace({}, '[0-9]+{s}[0-9]+{s}[0-9]+', '', 'g')"


def strip_sql(column: str) -> str:
    for separator in "/-:":
        column = _STRIP.format(column, s=separator)
    return column


@query("strip_datetimes", f"SELECT doc_id, {strip_sql('text')} AS text FROM documents")
def strip_datetimes(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select(
        "doc_id", text.strip_datetimes("text").alias("text")
    )


def snake_sql(column: str) -> str:
    return f"lower(regexp_replace(regexp_replace({column}, '([A-Z])', '_\\1', 'g'), '^_', ''))"


@query(
    "camel_to_snake",
    f"""SELECT p_partkey, {snake_sql("concat(p_type, p_brand)")} AS snake,
        {snake_sql("translate(concat('a', p_name, '.', p_brand, '-', p_type), ' .-', '___')")} AS name
        FROM part""",
)
def camel_to_snake(spark, sf_dir):
    return views.table(spark, sf_dir, "part").select(
        "p_partkey",
        text.camel_to_snake(F.concat("p_type", "p_brand")).alias("snake"),
        text.normalise_name(
            F.concat(F.lit("a"), "p_name", F.lit("."), "p_brand", F.lit("-"), "p_type")
        ).alias("name"),
    )


@query(
    "bvalue_ge",
    views.oracle(
        r"""SELECT instance_id,
        CASE WHEN length(b) > 5 THEN ltrim(right(b, 4), '0') ELSE b END AS bvalue
        FROM (SELECT instance_id, split_part(concat(diffusion_bvalue_ge, chr(92), '7', chr(92), '8'), chr(92), 1) AS b
              FROM v_instances)""",
        "v_instances",
    ),
)
def bvalue_ge(spark, sf_dir):
    listed = F.concat("diffusion_bvalue_ge", F.lit("\\7\\8"))
    return views.instances(spark, sf_dir).select("instance_id", bvalues.ge_bvalue(listed).alias("bvalue"))


@query(
    "bvalue_bytes",
    """SELECT event_id, CASE WHEN user_id * 37 > 5000 THEN concat('h', event_type)
       ELSE cast(user_id * 37 AS varchar) END AS bvalue FROM events""",
)
def bvalue_bytes(spark, sf_dir):
    raw = F.unhex(F.lpad(F.hex(F.col("user_id") * 37), 8, "0"))
    return views.table(spark, sf_dir, "events").select(
        "event_id", bvalues.bytes_bvalue(raw, F.concat(F.lit("h"), "event_type")).alias("bvalue")
    )


_FIRST = (
    "coalesce(nullif(diffusion_bvalue, '-'), nullif(diffusion_bvalue_ge, '-'), "
    "nullif(diffusion_bvalue_siemens, '-'), '-')"
)


@query(
    "bvalue_final",
    views.oracle(f"SELECT instance_id, {_FIRST} AS diffusion_bvalue_final FROM v_instances", "v_instances"),
)
def bvalue_final(spark, sf_dir):
    from seriesloom.sources.tags import with_final_bvalue

    return with_final_bvalue(views.instances(spark, sf_dir)).select("instance_id", "diffusion_bvalue_final")


@query(
    "bvalue_resolve",
    views.oracle(f"SELECT instance_id, {_FIRST} AS bvalue FROM v_instances", "v_instances"),
)
def bvalue_resolve(spark, sf_dir):
    df = views.instances(spark, sf_dir)
    return df.select("instance_id", resolved_bvalue(df).alias("bvalue"))


@query(
    "join_multivalue",
    views.oracle(
        """SELECT instance_id, coalesce(replace(image_type, chr(92), ' '), '-') AS from_text,
        concat(manufacturer, ' ', echo_time) AS from_list FROM v_instances""",
        "v_instances",
    ),
)
def join_multivalue(spark, sf_dir):
    return views.instances(spark, sf_dir).select(
        "instance_id",
        text.join_backslashes("image_type").alias("from_text"),
        text.join_list(F.array("manufacturer", "echo_time")).alias("from_list"),
    )


MAX_TOKEN = (
    "least(coalesce(list_max(list_transform(regexp_extract_all({0}, '\\S+'), lambda t: "
    "CASE WHEN regexp_full_match(t, '([0-9]+\\.?[0-9]*|\\.[0-9]+)') THEN trunc(cast(t AS double)) "
    "ELSE 0 END)), 0), 2147483647)"
)


@query(
    "max_token_number",
    views.oracle(
        f"""SELECT instance_id, cast({MAX_TOKEN.format("cell")} AS int) AS top FROM
        (SELECT instance_id, concat(echo_time, ' 1.5.2 ', diffusion_bvalue, ' 12.75  x') AS cell FROM v_instances)""",
        "v_instances",
    ),
)
def max_token_number(spark, sf_dir):
    cell = F.concat("echo_time", F.lit(" 1.5.2 "), "diffusion_bvalue", F.lit(" 12.75  x"))
    return views.instances(spark, sf_dir).select("instance_id", bvalues.max_token_number(cell).alias("top"))


_TOKENS = "regexp_extract_all(lower(series_description), '\\S+')"


@query(
    "token_match",
    views.oracle(
        f"""SELECT instance_id,
        list_contains({_TOKENS}, 't2') AND NOT list_contains({_TOKENS}, 'cor')
          AND NOT list_contains({_TOKENS}, 'sag') AS every_one,
        list_contains({_TOKENS}, 'dwi') OR NOT list_contains({_TOKENS}, 'adc') AS any_one,
        list_contains(string_split(lower(series_description), ' '), '') AS blank FROM v_instances""",
        "v_instances",
    ),
)
def token_match(spark, sf_dir):
    return views.instances(spark, sf_dir).select(
        "instance_id",
        text.has_tokens("series_description", ["t2", "~cor", "~sag"]).alias("every_one"),
        text.has_tokens("series_description", ["dwi", "~adc"], how="any").alias("any_one"),
        text.has_tokens("series_description", "", separator=" ").alias("blank"),
    )


@query(
    "label_decode",
    views.oracle(
        "SELECT row_id, fold, ['ADC', 'DCE', 'DWI', 'OTHERS', 'T2W'][y_pred + 1] AS label FROM v_votes",
        "v_votes",
    ),
)
def label_decode(spark, sf_dir):
    labels = ["adc", "dce", "dwi", "others", "t2w"]
    return views.votes(spark, sf_dir).select("row_id", "fold", text.label_of("y_pred", labels).alias("label"))


_NUMBERS = (
    "list_transform(string_split({0}, ' '), lambda t: CASE WHEN regexp_full_match(t, "
    "'[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN cast(t AS double) END)"
)


@query(
    "number_token_features",
    views.oracle(
        f"""SELECT instance_id, cast(coalesce(len(l), -1) AS double) AS length,
        CASE WHEN l IS NULL THEN -1 ELSE round(coalesce(list_sum(l), 0), 6) END AS sum,
        coalesce(list_min(l), -1) AS min, coalesce(list_max(l), -1) AS max,
        round(coalesce(list_avg(l), -1), 6) AS mean
        FROM (SELECT instance_id, {_NUMBERS.format("cell")} AS l FROM
          (SELECT instance_id, CASE WHEN instance_id % 19 = 0 THEN NULL
             ELSE concat(echo_time, ' 1f -2.5 1e2') END AS cell FROM v_instances WHERE instance_id % 2 = 0
           UNION ALL SELECT instance_id, echo_time FROM v_instances WHERE instance_id % 2 = 1))""",
        "v_instances",
    ),
)
def number_token_features(spark, sf_dir):
    longer = F.concat("echo_time", F.lit(" 1f -2.5 1e2"))
    cell = F.when(F.col("instance_id") % 2 == 1, F.col("echo_time")).when(
        F.col("instance_id") % 19 != 0, longer
    )
    out = views.instances(spark, sf_dir).select("instance_id", numbers.token_features(cell).alias("f"))
    return out.select(
        "instance_id",
        "f.length",
        F.round("f.sum", 6).alias("sum"),
        "f.min",
        "f.max",
        F.round("f.mean", 6).alias("mean"),
    )


@query(
    "number_token_fixed",
    """SELECT l_orderkey, l_linenumber, cast(l_partkey AS double) AS first, cast(NULL AS double) AS second,
       cast(l_suppkey AS double) + 0.5 AS third FROM lineitem""",
)
def number_token_fixed(spark, sf_dir):
    cell = F.concat_ws(" ", "l_partkey", F.lit("x"), F.concat(F.col("l_suppkey").cast("string"), F.lit(".5")))
    out = views.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", numbers.fixed_tokens(cell, 3).alias("n")
    )
    names = ("first", "second", "third")
    return out.select(
        "l_orderkey", "l_linenumber", *[F.get("n", F.lit(i)).alias(name) for i, name in enumerate(names)]
    )


# the library's tokens: runs of two or more Unicode word characters
_WORDS = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]{2,}"
_NEXT = ", ".join(f"lead(a, {n}) OVER o AS a{n}" for n in range(1, 5))
_GRAMS = " UNION ALL ".join(
    "SELECT doc_id, " + " || ' ' || ".join(["a", *[f"a{n}" for n in range(1, size)]]) + " AS term FROM runs"
    for size in range(1, 6)
)


@query(
    "text_counts",
    f"""WITH cut AS (SELECT doc_id, regexp_extract_all(lower(text), '{_WORDS}') AS w FROM documents),
    words AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM cut),
    runs AS (SELECT doc_id, a, {_NEXT} FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    grams AS ({_GRAMS}),
    counted AS (SELECT term, count(DISTINCT doc_id) AS n_rows FROM grams WHERE term IS NOT NULL GROUP BY term)
    SELECT 'text' AS "column", term, n_rows FROM counted
    WHERE n_rows >= 0.01 * (SELECT count(*) FROM documents)""",
)
def count_text(spark, sf_dir):
    return text_counts(views.table(spark, sf_dir, "documents"), ["text"])
