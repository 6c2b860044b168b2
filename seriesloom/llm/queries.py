"""The registered queries of the operators, and the SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm import (
    chat,
    decontaminate,
    language_model,
    manifest,
    mixing,
    near_dedup,
    pii,
    quality,
    repeats,
    secret_scan,
    spelling,
    url_filter,
    warc,
)
from seriesloom.session import materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

URL_RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), percent=85).drop("row_key")


@_query
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.fit_url_model(url_filter.seed_urls(spark))
    return url_filter.judge(_table(spark, sf_dir, "pages"), URL_RULES, model)


@_query
def op3_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.convert_pages(_table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query
def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "share", "block", "slot", "position")


@_query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secret_scan.fit_forest(secret_scan.labelled_findings(spark))
    found = secret_scan.scan(_table(spark, sf_dir, "documents"), model)
    secrets = F.filter("findings", lambda x: x["is_secret"])
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        F.size("findings").cast("long").alias("n_candidates"),
        F.size(secrets).cast("long").alias("n_secrets"),
        F.array_join(F.transform(secrets, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",").alias("spans"),
    )


@_query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.match(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        (F.size("hits") > 0).alias("contaminated"),
        F.col("hits.item_id").alias("item_ids"),
        F.col("hits.distance").alias("distances"),
    )


@_query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    figures = quality.measure(_table(spark, sf_dir, "documents"))
    figures = figures.select(F.col("row.doc_id").alias("doc_id"), *figures.columns[1:])
    judged = quality.judge(materialise(figures, "figures"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@_query
def op8_context_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(_table(spark, sf_dir, "documents"))


@_query
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.extract(_table(spark, sf_dir, "documents"))
    names = F.array(*[F.lit(k) for k in pii.KINDS])

    def text_of(spans: str):
        parts = F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"]))
        return F.array_join(parts, ",")

    def count(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)],
        F.sha2(text_of("base"), 256).alias("base_sha256"),
        text_of("spans").alias("spans"),
    )


@_query
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    # two rows made by Spark itself, so that no Python worker is started
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    probe = spark.range(2).select(F.lit(-1).alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(said).alias("text"))
    probe = probe.select(*[F.col(f.name).cast(f.dataType) for f in turns.schema])
    chats = chat.format_chats(turns.union(probe))
    read = chat.read_chats(chats)
    per_turn = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(per_turn, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


# ---------------------------------------------------------------- SQL

ORACLE["op1_minhash_near_dedup"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 OR w IS NULL THEN []::varchar[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, other) AS (
  SELECT a, b FROM both_ways UNION SELECT r.node, l.b FROM reach r JOIN both_ways l ON l.a = r.other),
least AS (SELECT node, min(other) AS other FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(s.n, 0)::bigint AS n_shingles, least(d.doc_id, coalesce(l.other, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(l.other, d.doc_id)) AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN least l ON l.node = d.doc_id
"""

ORACLE["op3_arc_to_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, strlen(payload)::bigint AS payload_bytes, sha1(payload) AS payload_digest FROM p),
f AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM f
"""


def _quality_sql() -> str:
    bins, cuts, tests = [], [], []
    for name, (over, under, per_unit, spread, two_sided) in quality.METRICS.items():
        bins.append(f"CASE WHEN {under} > 0 THEN {per_unit} * {over} // {under} ELSE 0 END AS b_{name}")
        cuts.append((name, spread, two_sided))
        tests.append(f"b_{name} BETWEEN coalesce(o.{name}.low, l.{name}.low, a.{name}.low) AND coalesce(o.{name}.high, l.{name}.high, a.{name}.high)")
    long = " UNION ALL ".join(f"SELECT lang, source, '{n}' AS metric, b_{n} AS bin FROM binned WHERE NOT base_failed" for n, _, _ in cuts)
    spread = "CASE metric " + " ".join(f"WHEN '{n}' THEN {s}" for n, s, _ in cuts) + " END"
    low = ", ".join(f"'{n}'" for n, _, t in cuts if t)
    wide = ", ".join(f"max(CASE WHEN metric = '{n}' THEN {{'low': low, 'high': high}} END) AS {n}" for n, _, _ in cuts)
    return f"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
  FROM w WHERE len(w) >= 5),
repeated AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM repeated) GROUP BY doc_id),
figures AS (
  SELECT w.doc_id, lang, source, len(w)::bigint AS n_words, length(array_to_string(w, ''))::bigint AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint AS n_dup_lines, coalesce(c.n, 0)::bigint AS n_repeat_words,
    length(regexp_replace(text, '[^A-Z]', '', 'g'))::bigint AS n_upper, len(lines)::bigint AS n_lines
  FROM w LEFT JOIN covered c USING (doc_id)),
binned AS (
  SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed, {", ".join(bins)} FROM figures),
long AS ({long}),
levels AS (
  SELECT lang, source, 0 AS level, metric, bin FROM long UNION ALL SELECT lang, NULL, 1, metric, bin FROM long
  UNION ALL SELECT NULL, NULL, 2, metric, bin FROM long),
counts AS (SELECT lang, source, level, metric, bin, count(*) AS n FROM levels GROUP BY ALL),
ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY lang, source, level, metric ORDER BY bin) AS upto,
    sum(n) OVER (PARTITION BY lang, source, level, metric) AS total FROM counts),
quartiles AS (
  SELECT lang, source, level, metric, max(total) AS n, min(CASE WHEN 4 * upto >= total THEN bin END) AS q1,
    min(CASE WHEN 4 * upto >= 3 * total THEN bin END) AS q3 FROM ranked GROUP BY ALL),
fences AS (
  SELECT lang, source, level, metric, n, CASE WHEN metric IN ({low}) THEN q1 - {quality.SPREADS} * greatest(q3 - q1, {spread}) ELSE -1 END AS low,
    q3 + {quality.SPREADS} * greatest(q3 - q1, {spread}) AS high FROM quartiles),
wide AS (SELECT lang, source, level, max(n) AS n, {wide} FROM fences GROUP BY lang, source, level)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce({" AND ".join(tests)}, true) AS kept
FROM binned b
LEFT JOIN wide o ON o.level = 0 AND o.n >= {quality.MIN_DOCS} AND b.lang IS NOT DISTINCT FROM o.lang AND b.source IS NOT DISTINCT FROM o.source
LEFT JOIN wide l ON l.level = 1 AND l.n >= {quality.MIN_DOCS} AND b.lang IS NOT DISTINCT FROM l.lang
LEFT JOIN wide a ON a.level = 2
"""


ORACLE["op7_quality"] = _quality_sql()

ORACLE["op10_chat_format"] = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
before AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS last FROM turns),
sized AS (
  SELECT *, length(replace(text, '<|', '<||')) + CASE WHEN last = role THEN length('<|im_sep|>')
    ELSE length('<|im_start|>') + length(replace(role, '<|', '<||')) + 1 + length('<|im_end|>') + 1 END AS chars FROM before)
SELECT conv_id, count(*)::bigint AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::bigint AS formatted_chars
FROM sized GROUP BY conv_id
"""


# ---------------------------------------------------------------- spelling, repeats, manifest


@_query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.prove(manifest.build(_table(spark, sf_dir, "documents"), manifest.tampered_text()))


@_query
def op11_spelling_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_forms(_table(spark, sf_dir, "documents"), every=31)


@_query
def op12_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.strip_repeats(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["high"] - s["low"])
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        F.coalesce(F.octet_length("row.text"), F.lit(0)).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


_CRC_SQL = """xor(4294967295, list_reduce(list_concat([4294967295::bigint],
  list_transform(range(1, strlen({0}) + 1), lambda i: ('0x' || substr(hex(encode({0})), 2 * i - 1, 2))::bigint)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""


def _manifest_sql(levels: int = 6) -> str:
    def part(value: str) -> str:
        return f"coalesce(strlen(({value})::varchar) || ':' || ({value})::varchar, '-')"

    fields = " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = [
        f"""leaves AS (
  SELECT doc_id, coalesce('=' || source, '-') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i,
    sha256({fields} || {part("text")}) AS leaf,
    CASE WHEN {_CRC_SQL.format("doc_id::varchar")} % 5 = 0 THEN sha256({fields} || {part(lower)}) ELSE sha256({fields} || {part("text")}) END AS claim
  FROM documents)"""
    ]

    def tree(name: str, first: str) -> str:
        """Levels of nodes (tree, i, d) with the digests before and after each in its run of 16; a single node stays as it is."""
        ctes.append(f"{name}0 AS (SELECT *, count(*) OVER (PARTITION BY tree) AS c FROM ({first}))")
        for k in range(levels):
            ctes.append(f"""{name}s{k} AS (
  SELECT a.tree, a.i, any_value(a.c) AS c, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l,
    coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM {name}{k} a JOIN {name}{k} b ON a.tree = b.tree AND a.i // 16 = b.i // 16 GROUP BY a.tree, a.i)""")
            ctes.append(f"""{name}{k + 1} AS (
  SELECT *, count(*) OVER (PARTITION BY tree) AS c FROM (
    SELECT tree, i // 16 AS i, CASE WHEN any_value(c) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d
    FROM {name}{k} GROUP BY tree, i // 16))""")
        return f"{name}{levels}"

    def fold(name: str, rows: str, key: str, place: str) -> str:
        """``rows`` with proof and fold taken through all levels of a tree."""
        for k in range(levels):
            ctes.append(f"""{name}f{k} AS (
  SELECT r.* EXCLUDE (fold, proof), proof || l || s.r AS proof, CASE WHEN s.c = 1 THEN fold ELSE sha256(l || fold || s.r) END AS fold
  FROM {rows} r JOIN {name}s{k} s ON s.tree = r.{key} AND s.i = r.{place} // {16**k})""")
            rows = f"{name}f{k}"
        return rows

    top = tree("n", "SELECT tree, i, leaf AS d FROM leaves")
    ctes.append(f"subroots AS (SELECT tree AS name, d, row_number() OVER (ORDER BY tree) - 1 AS place FROM {top})")
    root = tree("m", "SELECT '' AS tree, place AS i, d FROM subroots")
    ctes.append(
        f"""started AS (
  SELECT doc_id, leaf, l.tree, l.i AS i, s.d AS subroot, place, '' AS top, o.d AS root, '' AS proof, claim AS fold
  FROM leaves l JOIN subroots s ON s.name = l.tree CROSS JOIN {root} o)"""
    )
    done = fold("m", fold("n", "started", "tree", "i"), "top", "place")
    return f"""WITH {", ".join(ctes)}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified FROM {done}"""


ORACLE["op11_spelling_forms"] = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS run FROM documents),
counted AS (SELECT coalesce(doc_id::varchar, '') || ':' || run AS tag, run, count(*) AS n FROM runs WHERE length(run) >= {spelling.LEAST_LETTERS} GROUP BY ALL),
hashed AS (SELECT run, n, {_CRC_SQL.format("tag")} AS h FROM counted),
altered AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
v AS (SELECT word, sum(n)::bigint AS n FROM altered WHERE length(word) >= {spelling.LEAST_LETTERS} GROUP BY word HAVING sum(n) >= {spelling.LEAST_COUNT}),
holes AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
pairs AS (
  SELECT a.word, b.word AS other FROM holes a JOIN holes b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT word, rest FROM holes WHERE rest IN (SELECT word FROM v)
  UNION SELECT rest, word FROM holes WHERE rest IN (SELECT word FROM v)),
ranked AS (
  SELECT p.word, p.other, v.n AS other_n, count(*) OVER (PARTITION BY p.word) AS n_near,
    row_number() OVER (PARTITION BY p.word ORDER BY v.n DESC, encode(p.other)) AS place FROM pairs p JOIN v ON v.word = p.other),
forms AS (
  SELECT v.word, v.n, coalesce(r.n_near, 0)::bigint AS n_near, CASE WHEN other_n >= {spelling.RATIO} * v.n THEN other END AS form,
    CASE WHEN other_n >= {spelling.RATIO} * v.n THEN other_n END AS form_n
  FROM v LEFT JOIN ranked r ON r.word = v.word AND r.place = 1),
reach(word, root, form) AS (
  SELECT word, word, form FROM forms UNION ALL SELECT r.word, f.word, f.form FROM reach r JOIN forms f ON f.word = r.form)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN reach r ON r.word = f.word AND r.form IS NULL
"""

ORACLE["op12_suffix_repeats"] = f"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, encode(coalesce(text, '')) AS b, strlen(coalesce(text, ''))::bigint AS n FROM documents),
windows AS (SELECT r, i, md5(array_slice(b, i + 1, i + {repeats.LENGTH})) AS w FROM (SELECT r, b, unnest(range(n - {repeats.LENGTH - 1})) AS i FROM t)),
hits AS (SELECT r, i FROM windows WHERE w IN (SELECT w FROM windows GROUP BY w HAVING count(*) > 1)),
marked AS (SELECT *, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + {repeats.LENGTH}, true) AS fresh FROM hits),
numbered AS (SELECT *, sum(fresh::int) OVER (PARTITION BY r ORDER BY i) AS span FROM marked),
spans AS (SELECT r, span, min(i) AS low, max(i) + {repeats.LENGTH} AS high FROM numbered GROUP BY r, span),
gaps AS (
  SELECT r, coalesce(lag(high) OVER (PARTITION BY r ORDER BY low), 0) AS low, low AS high FROM spans
  UNION ALL SELECT r, max(high), NULL FROM spans GROUP BY r),
kept AS (
  SELECT t.r, unhex(string_agg(hex(array_slice(b, g.low + 1, coalesce(g.high, n))), '' ORDER BY g.low)) AS b
  FROM gaps g JOIN t USING (r) GROUP BY t.r),
sums AS (SELECT r, sum(high - low)::bigint AS removed, count(*) AS spans FROM spans GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(removed, 0)::bigint AS n_removed, coalesce(spans, 0)::bigint AS n_spans, sha256(coalesce(k.b, t.b)) AS kept_sha256
FROM t LEFT JOIN sums USING (r) LEFT JOIN kept k USING (r)
"""

ORACLE["op13_merkle_manifest"] = _manifest_sql()
