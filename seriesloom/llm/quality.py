"""Quality rules with thresholds learnt per language and source, DataFrame expressions only.

``measure`` takes each text's figures. ``thresholds`` sketches every metric's distribution per
(lang, source): a metric is cut into bins of fixed width and the sketch is the count per bin, so
sketches merge by adding counts, in any order with one result, and a quantile is off by at most the
width of a bin. Counting is combined before the shuffle, so a hot source costs one row per bin and task.
A group's fence is Q3 + SPREADS * max(IQR, spread) (and Q1 - ... where low values are bad too). Groups
of fewer than MIN_DOCS documents use the merged sketch of their language, or of everything.
``judge`` joins the fences to the figures.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesloom.llm.words import NOT_SPACE, SPACE, WINDOW

SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MIN_DOCS = 50  # documents a group needs for a sketch of its own
SPREADS = 3  # interquartile ranges beyond the quartile

#: metric -> (numerator, denominator, bins per unit, least interquartile range in bins, low values are bad too)
METRICS = {
    "word_length": ("word_chars", "n_words", 10, 8, True),
    "symbol_share": ("n_symbols", "n_words", 100, 5, False),
    "upper_share": ("n_upper", "word_chars", 100, 5, False),
    "dup_line_share": ("n_dup_lines", "n_lines", 100, 10, False),
    "repeat_share": ("n_repeat_words", "n_words", 100, 7, False),
}


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeat_words(words: Column) -> Column:
    """Of an array held in a lambda variable or column: words inside 5-word windows that occur at least twice in the text, first occurrences included.

    Windows are compared by 64-bit hash. Only where some window repeats, the windows are sorted by hash,
    the places of repeated ones sorted, and the covered words counted.
    """

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = F.filter(
                F.transform(
                    s,
                    lambda x, i: F.when(
                        (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["i"]
                    ),
                ),
                lambda x: x.isNotNull(),
            )
            return F.sort_array(same)

        def total(p: Column) -> Column:
            gaps = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

        return _let(placed, lambda s: _let(places(s), total))

    def of_words(w: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])
        )
        count = _let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))
        return F.when(F.size(w) >= WINDOW, count).otherwise(F.lit(0).cast("long"))

    return of_words(words)


def measure(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` as struct ``row`` beside its figures, lang and source.

    A null text has no words, symbols or lines.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, SPACE + "+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE))
    rows = docs.select(
        F.struct("*").alias("row"),
        F.col("lang").alias("lang"),
        F.col("source").alias("source"),
        text.alias("text"),
    )
    return rows.select(
        "row",
        "lang",
        "source",
        (F.size(F.split("text", SYMBOLS)) - 1).cast("long").alias("n_symbols"),
        (F.size(F.split("text", "[A-Z]")) - 1).cast("long").alias("n_upper"),
        _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("_lines"),
        _let(words, lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), repeat_words(w).alias("repeat"))).alias("_words"),
    ).select(
        "row",
        "lang",
        "source",
        F.col("_words.n").cast("long").alias("n_words"),
        F.col("_words.chars").cast("long").alias("word_chars"),
        "n_symbols",
        F.col("_lines.dup").cast("long").alias("n_dup_lines"),
        F.col("_words.repeat").alias("n_repeat_words"),
        "n_upper",
        F.col("_lines.n").cast("long").alias("n_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _bin(metric: str) -> Column:
    over, under, per_unit, _, _ = METRICS[metric]
    whole = F.expr(f"{per_unit} * {over} div {under}")
    return F.when(F.col(under) > 0, whole).otherwise(F.lit(0)).cast("long")


def _binned(figures: DataFrame) -> DataFrame:
    return figures.select("*", *[_bin(m).alias(f"_{m}") for m in METRICS])


def sketches(figures: DataFrame) -> DataFrame:
    """Sketch rows (lang, source, metric, bin, n) of the documents that pass the base rules."""
    kinds = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"_{m}").alias("bin")) for m in METRICS]))
    rows = _binned(figures.where(~base_failed())).select("lang", "source", kinds.alias("m"))
    return rows.groupBy("lang", "source", F.col("m.metric").alias("metric"), F.col("m.bin").alias("bin")).agg(F.count("*").alias("n"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """Fences (lang, source, level, metric, n, low, high) in bins.

    level 0 is a group's own sketch, level 1 the merged one of a language (source null), level 2 that of
    all (both null). The quartiles are the least bins that reach a quarter and three quarters of the count.
    """
    none = F.lit(None).cast("string")
    levels = [
        sketch.select("lang", "source", F.lit(0).alias("level"), "metric", "bin", "n"),
        sketch.select("lang", none.alias("source"), F.lit(1).alias("level"), "metric", "bin", "n"),
        sketch.select(none.alias("lang"), none.alias("source"), F.lit(2).alias("level"), "metric", "bin", "n"),
    ]
    keys = ["lang", "source", "level", "metric"]
    merged = reduce(DataFrame.union, levels).groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
    group = W.partitionBy(*keys)
    ranked = merged.withColumn("upto", F.sum("n").over(group.orderBy("bin"))).withColumn("total", F.sum("n").over(group))
    cut = ranked.groupBy(*keys).agg(
        F.max("total").alias("n"),
        F.min(F.when(F.expr("4 * upto >= total"), F.col("bin"))).alias("q1"),
        F.min(F.when(F.expr("4 * upto >= 3 * total"), F.col("bin"))).alias("q3"),
    )
    spread = reduce(lambda c, m: c.when(F.col("metric") == m, METRICS[m][3]), list(METRICS)[1:], F.when(F.col("metric") == list(METRICS)[0], METRICS[list(METRICS)[0]][3]))
    two_sided = F.col("metric").isin([m for m in METRICS if METRICS[m][4]])
    reach = SPREADS * F.greatest(F.col("q3") - F.col("q1"), spread)
    return cut.select(
        *keys,
        "n",
        F.when(two_sided, F.col("q1") - reach).otherwise(F.lit(-1)).cast("long").alias("low"),
        (F.col("q3") + reach).cast("long").alias("high"),
    )


def judge(figures: DataFrame) -> DataFrame:
    """``figures`` (see ``measure``) with base_failed and kept.

    A row that passes the base rules is kept if all its metrics lie within the fences of its group:
    those of (lang, source), or of the language or of all rows where the group is smaller than MIN_DOCS.
    A null lang or source is a group of its own. An empty table gives an empty result.
    """
    fences = thresholds(sketches(figures))
    wide = fences.groupBy("lang", "source", "level").agg(
        F.max("n").alias("n"),
        *[F.max(F.when(F.col("metric") == m, F.struct("low", "high"))).alias(m) for m in METRICS],
    )
    limits = F.struct(*METRICS)
    # one row per language and source, per language, and in all
    own = wide.where(f"level = 0 and n >= {MIN_DOCS}").select("lang", "source", limits.alias("own"))
    by_lang = wide.where(f"level = 1 and n >= {MIN_DOCS}").select("lang", limits.alias("by_lang"))
    overall = wide.where("level = 2").select(limits.alias("overall"))
    groups = figures.select("lang", "source").distinct().alias("g")
    chosen = (
        groups.join(own.alias("o"), F.expr("g.lang <=> o.lang and g.source <=> o.source"), "left")
        .join(by_lang.alias("l"), F.expr("g.lang <=> l.lang"), "left")
        .join(overall, F.lit(True), "left")
        .select("g.lang", "g.source", F.coalesce("own", "by_lang", "overall").alias("limits"))
    )
    rows = _binned(figures).alias("r").join(chosen.alias("c"), F.expr("r.lang <=> c.lang and r.source <=> c.source"), "left")
    within = reduce(
        lambda a, b: a & b, [F.col(f"_{m}").between(F.col(f"limits.{m}.low"), F.col(f"limits.{m}.high")) for m in METRICS]
    )
    return rows.select(
        *[F.col(f"r.{c}").alias(c) for c in figures.columns],
        base_failed().alias("base_failed"),
        (~base_failed() & F.coalesce(within, F.lit(True))).alias("kept"),
    )
