"""Joins, name matching and label grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.functions.text import normalise_name


def merge_target(
    features: DataFrame, targets: DataFrame, on: Sequence[str], target: str = "class"
) -> DataFrame:
    """Features with their target; rows without one are dropped.

    Spark chooses the strategy from the sizes it measures: broadcast for a small target table, else a
    sort-merge join whose hot partitions are split.
    """
    return features.join(targets.select(*on, target), list(on), "inner")


def join_group_map(df: DataFrame, groups: DataFrame, on: str = "study_uid") -> DataFrame:
    """Attach the group of each study; studies outside the map are dropped."""
    return df.join(groups, on, "inner")


def label_grid(spark: SparkSession, labels: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """Every pair (true, pred) of a fixed label list, in list order.

    A mapping ``{data label: display name}`` also renames; both spellings are returned.
    """
    pairs = list(labels.items()) if isinstance(labels, Mapping) else [(v, v) for v in labels]
    choices = F.array(*[F.struct(F.lit(v).alias("value"), F.lit(n).alias("name")) for v, n in pairs])
    return (
        spark.range(1)
        .select(F.explode(choices).alias("t"))
        .select("t", F.explode(choices).alias("p"))
        .select(
            F.col("t.value").alias("true_value"),
            F.col("p.value").alias("pred_value"),
            F.col("t.name").alias("true"),
            F.col("p.name").alias("pred"),
        )
    )


def fuzzy_match_names(
    candidates: DataFrame, column: str, known: Sequence[str], threshold: float = 0.8
) -> DataFrame:
    """Best candidate per known name by edit similarity, NULL unless above the threshold.

    Every distinct candidate meets the fixed list of known names in a map-only step; the best is a
    partial aggregate, so only one row per known name and task is shuffled. Ties go to the
    alphabetically first candidate.
    """
    best = name_similarities(candidates, column, known).groupBy("known").agg(
        F.min(F.struct((-F.col("similarity")).alias("distance"), F.col("candidate"))).alias("best")
    )
    similarity = -F.col("best.distance")
    return best.select(
        "known",
        F.when(similarity > threshold, F.col("best.candidate")).alias("candidate"),
        similarity.alias("similarity"),
    )


def name_similarities(candidates: DataFrame, column: str, known: Sequence[str]) -> DataFrame:
    """(known, candidate, similarity) of every distinct candidate and known name."""
    names = candidates.select(F.col(column).alias("candidate")).distinct()
    similarity = 1 - F.levenshtein(F.col("known"), F.col("plain")) / F.greatest(
        F.length("known"), F.length("plain")
    )
    return names.select(
        "candidate",
        normalise_name("candidate").alias("plain"),
        F.explode(F.array(*[F.lit(k) for k in known])).alias("known"),
    ).select("known", "candidate", similarity.alias("similarity"))


def auto_match_columns(df: DataFrame, known: Sequence[str], threshold: float = 0.8) -> tuple[dict[str, str], list[str]]:
    """Rename map ``{column: known name}`` for a table's columns, and the names that found no match.

    One-to-one: the most similar pair is taken first, and neither of its names again. Ties go by known
    name, then by column name.
    """
    names = df.sparkSession.createDataFrame([(c,) for c in df.columns], "name string")
    near = name_similarities(names, "name", known).where(F.col("similarity") > threshold).collect()
    matched: dict[str, str] = {}
    for row in sorted(near, key=lambda r: (-r.similarity, r.known, r.candidate)):
        if row.candidate not in matched and row.known not in matched.values():
            matched[row.candidate] = row.known
    return matched, sorted(set(known) - set(matched.values()))
