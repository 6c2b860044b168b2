"""Turning text, number-token and numeric columns into one feature vector."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.ngrams import longer_ngrams, placed_words, word_ngrams, word_tokens
from seriesloom.functions.numbers import FEATURES, token_features
from seriesloom.roles import Roles
from seriesloom.session import materialise

LONGEST_NGRAM = 5
MIN_SHARE = 0.01


def text_counts(
    df: DataFrame,
    columns: Sequence[str],
    min_share: float = MIN_SHARE,
    longest: int = LONGEST_NGRAM,
    tokens=word_tokens,
) -> DataFrame:
    """(column, term, n_rows): word n-grams found in at least ``min_share`` of the rows.

    Header text repeats a lot, so equal texts are counted first and only distinct ones are split. Longer
    n-grams are mined level by level: an (n+1)-gram of a text is counted only if both of its n-grams are
    frequent, which most n-grams of a large table are not.
    """
    cells = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("text"))
                for c in columns
            ]
        )
    )
    texts = df.select(cells.alias("cell")).groupBy("cell.column", "cell.text").agg(F.count(F.lit(1)).alias("n"))
    texts = materialise(texts, "texts")
    least = F.lit(min_share * df.count())
    state, found = texts.select("column", "n", placed_words(tokens("text")).alias("grams")), []
    while True:
        frequent = materialise(count_grams(state).where(F.col("n_rows") >= least), "terms")
        found.append(frequent)
        marks = _frequent_marks(frequent) if len(found) < longest else None
        if marks is None:
            return reduce(DataFrame.union, found)
        state = extend_grams(state, marks)
        if len(found) == 1:  # the words are read and cut once; what is left of them is small
            state = materialise(state, "grams")


def count_grams(state: DataFrame) -> DataFrame:
    """(column, term, n_rows) of all n-grams in (column, n, grams), n being the rows that hold the text."""
    grams = state.select("column", "n", F.explode(F.array_distinct("grams.gram")).alias("term"))
    return grams.groupBy("column", "term").agg(F.sum("n").alias("n_rows"))


def extend_grams(state: DataFrame, marks: DataFrame) -> DataFrame:
    """The texts with the (n+1)-grams whose n-grams are marked in ``marks`` (one row, see ``_frequent_marks``)."""

    def frequent(gram: Column) -> Column:
        return F.get(F.col("_marks"), _mark_of(F.col("column"), gram))

    longer = longer_ngrams("grams", frequent).alias("grams")
    return state.withColumn("_marks", marks.scalar()).select("column", "n", longer)


MARKS = 1 << 20


def _mark_of(column: Column, gram: Column) -> Column:
    return F.pmod(F.hash(column, gram), F.lit(MARKS))


def _frequent_marks(terms: DataFrame) -> DataFrame | None:
    """One row with an array of MARKS flags, set where a term's hash points; None without terms.

    Its size does not depend on the table. Terms that share a place are counted in vain and fall to the
    exact count.
    """
    found = terms.select(_mark_of(F.col("column"), F.col("term")).alias("mark")).distinct().collect()
    if not found:
        return None
    marks = np.zeros(MARKS, bool)
    marks[[row.mark for row in found]] = True
    row = pa.table({"marks": pa.ListArray.from_arrays(pa.array([0, MARKS], pa.int32()), pa.array(marks))})
    return terms.sparkSession.createDataFrame(row)


GRAMS, COUNTS, NUMBERS, MISSING_COUNT = "_grams", "_counts", "_numbers", "_missing"


def number_names(roles: Roles) -> list[str]:
    """Names of the entries of the number vector."""
    return [f"{c}:{feature}" for c in roles.number_token for feature in FEATURES] + list(roles.numeric)


def term(column: str, gram: str) -> str:
    return f"{column}:{gram}"


def add_grams(df: DataFrame, roles: Roles, longest: int = LONGEST_NGRAM) -> DataFrame:
    """``_grams``: the n-grams of all text columns, each behind its column's name."""
    texts = [c for c in roles.text if c in df.columns]
    grams = [word_ngrams(word_tokens(c), longest, term(c, "")) for c in texts]
    return df.withColumn(GRAMS, F.concat(*grams) if grams else F.array().cast("array<string>"))


def add_numbers(df: DataFrame, roles: Roles, missing: float = -1.0) -> DataFrame:
    """``_numbers``: token features and numeric columns as one vector; ``_missing``: absent numeric ones.

    The vector has the entries of ``number_names(roles)``, whatever columns the table has. What is absent
    enters it as ``missing``, the mark the token features use; a column the table lacks is absent in
    every row, and only gaps in columns it has are counted.
    """
    names = set(df.columns)

    def cell(column: str) -> Column:
        return F.col(column) if column in names else F.lit(None)

    tokens = {c: token_features(cell(c).cast("string")) for c in roles.number_token}
    numeric = {f"_value_{c}": cell(c).try_cast("double") for c in roles.numeric}
    cells = {**{f"_token_{c}": value for c, value in tokens.items()}, **numeric}
    out = df.withColumns(cells) if cells else df

    def absent(column: str) -> Column:
        return F.col(column).isNull() | F.isnan(column)

    parts = [F.col(f"_token_{c}")[feature] for c in tokens for feature in FEATURES]
    parts += [F.when(absent(c), F.lit(missing)).otherwise(F.col(c)) for c in numeric]
    gaps = [F.when(absent(f"_value_{c}"), 1).otherwise(0) for c in roles.numeric if c in names]
    return out.withColumns(
        {
            NUMBERS: array_to_vector(F.array(*parts) if parts else F.array().cast("array<double>")),
            MISSING_COUNT: sum(gaps[1:], gaps[0]) if gaps else F.lit(0),
        }
    ).drop(*cells)


def split_columns(df: DataFrame, roles: Roles, fitted: bool = False) -> DataFrame:
    """Text and number features of every row; needs no fitting and no shuffle.

    For a table to learn from, ``roles`` shrink to the columns it has. For one to score give the fitted
    plan's roles and ``fitted=True``: the features are then the plan's, whatever the table has.
    """
    roles = roles if fitted else roles.present(df.columns)
    return add_numbers(add_grams(df, roles), roles)


@dataclass(frozen=True)
class FeaturePlan:
    """Fitted vectoriser: the vocabulary over all text columns and the number columns."""

    roles: Roles
    vocabulary: list[str] = field(default_factory=list)

    @property
    def names(self) -> list[str]:
        return [*self.vocabulary, *number_names(self.roles)]

    def stages(self, output: str = "features") -> list[Transformer]:
        """Pipeline stages over a table prepared by ``split_columns``."""
        size = VectorSizeHint(
            inputCol=NUMBERS, size=len(number_names(self.roles)), handleInvalid="error"
        )
        if not self.vocabulary:
            return [size, VectorAssembler(inputCols=[NUMBERS], outputCol=output, handleInvalid="keep")]
        counter = CountVectorizerModel.from_vocabulary(
            self.vocabulary, inputCol=GRAMS, outputCol=COUNTS, binary=True
        )
        joined = VectorAssembler(inputCols=[COUNTS, NUMBERS], outputCol=output, handleInvalid="keep")
        return [counter, size, joined]


def fit_features(df: DataFrame, roles: Roles, min_share: float = MIN_SHARE) -> FeaturePlan:
    """Learn the vocabulary. It comes to the driver, as in any fitted vectoriser.

    A term is in at least ``min_share`` of the rows, so there are at most 1/min_share times the mean
    number of n-grams per row, however many rows there are.
    """
    roles = roles.present(df.columns)
    vocabulary = []
    if roles.text:
        for row in text_counts(df, roles.text, min_share).select("column", "term").collect():
            vocabulary.append((roles.text.index(row.column), row.term))
    return FeaturePlan(roles, [term(roles.text[i], gram) for i, gram in sorted(vocabulary)])


def without_nan_rows(df: DataFrame, allowed: int = 1) -> DataFrame:
    """Prepared rows with at most ``allowed`` missing numeric features; token features never are."""
    return df.filter(F.col(MISSING_COUNT) <= allowed)


def assemble_features(df: DataFrame, roles: Roles, min_share: float = MIN_SHARE) -> tuple[DataFrame, FeaturePlan]:
    """Table with a ``features`` vector, and the plan that names its entries."""
    plan = fit_features(df, roles, min_share)
    out = PipelineModel(stages=plan.stages()).transform(split_columns(df, plan.roles))
    return out.drop(GRAMS, NUMBERS, MISSING_COUNT, COUNTS), plan
