"""Features of cells that hold space-separated numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seriesloom.functions import as_column

# Spark would also read "1f" or "1d" as numbers, hence the guard.
_NUMBER = r"^(?i)([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|[+-]?(nan|inf|infinity))$"

FEATURES = ("length", "sum", "min", "max", "mean")


def parse_number(token: Column | str) -> Column:
    """Text → double, NULL where it is no number."""
    token = as_column(token)
    return F.when(token.rlike(_NUMBER), token.try_cast("double"))


def parse_tokens(value: Column | str) -> Column:
    """Tokens between single spaces as doubles; bad and empty tokens stay as NULL."""
    return F.transform(F.split(as_column(value), " "), parse_number)


def token_features(value: Column | str, missing: float = -1.0) -> Column:
    """Struct of length, sum, min, max and mean over the tokens of one cell, in a single pass.

    Length counts every token. Bad tokens do not enter the sums, NaN does not enter min and max, and
    every undefined result becomes ``missing``. The sum of no number at all is 0.
    """
    value = as_column(value)
    nothing = F.lit(None).cast("double")
    start = F.struct(
        F.lit(0.0).alias("length"),
        F.lit(0.0).alias("n"),
        F.lit(0.0).alias("sum"),
        nothing.alias("min"),
        nothing.alias("max"),
    )

    def step(acc: Column, number: Column) -> Column:
        ordered = F.when(~F.isnan(number), number)
        return F.struct(
            (acc["length"] + 1.0).alias("length"),
            (acc["n"] + F.when(number.isNull(), 0.0).otherwise(1.0)).alias("n"),
            (acc["sum"] + F.coalesce(number, F.lit(0.0))).alias("sum"),
            F.least(acc["min"], ordered).alias("min"),
            F.greatest(acc["max"], ordered).alias("max"),
        )

    def known(c: Column) -> Column:
        return F.coalesce(F.when(~F.isnan(c), c), F.lit(missing))

    def finish(acc: Column) -> Column:
        return F.struct(
            acc["length"].alias("length"),
            known(acc["sum"]).alias("sum"),
            known(acc["min"]).alias("min"),
            known(acc["max"]).alias("max"),
            known(F.try_divide(acc["sum"], acc["n"])).alias("mean"),
        )

    absent = F.struct(*[F.lit(missing).alias(name) for name in FEATURES])
    return F.coalesce(F.aggregate(parse_tokens(value), start, step, finish), absent)


def fixed_tokens(value: Column | str, width: int) -> Column:
    """Array of exactly ``width`` numbers; a cell of another width is an error."""
    numbers = parse_tokens(value)
    return F.when(F.size(numbers) == width, numbers).otherwise(
        F.raise_error(F.lit(f"expected {width} numbers in every cell")).cast("array<double>")
    )
