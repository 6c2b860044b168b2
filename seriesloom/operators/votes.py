"""Combining the predictions of several models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def consensus_mode(
    votes: DataFrame, keys: Sequence[str], vote: str = "y_pred", name: str = "prediction"
) -> DataFrame:
    """Most frequent vote per row, upper-cased when text; a tie goes to the smallest vote."""
    winner = F.mode(F.col(vote), deterministic=True)
    if votes.schema[vote].dataType.typeName() == "string":
        winner = F.upper(winner)
    return votes.groupBy(*keys).agg(winner.alias(name))


def average_predictions(
    votes: DataFrame, keys: Sequence[str], vote: str = "y_pred", name: str = "prediction"
) -> DataFrame:
    """Mean prediction per row."""
    return votes.groupBy(*keys).agg(F.avg(F.col(vote).try_cast("double")).alias(name))


def mode_of(votes: Sequence[Column]) -> Column:
    """Most frequent of a few columns of one row; a tie goes to the smallest. Needs no shuffle."""

    def ballot(choice: Column) -> Column:
        agreeing = [F.when(choice == vote, 1).otherwise(0) for vote in votes]
        return F.struct((-sum(agreeing[1:], agreeing[0])).alias("n"), choice.alias("vote"))

    return F.least(*[ballot(v) for v in votes])["vote"] if len(votes) > 1 else votes[0]


def mean_of(votes: Sequence[Column]) -> Column:
    """Mean of a few columns of one row."""
    return sum(votes[1:], votes[0]) / len(votes)
