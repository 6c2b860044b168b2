"""Diffusion b-value extraction across vendors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from seriesloom.functions import as_column
from seriesloom.functions.text import split_blank
from seriesloom.roles import MISSING

# Fixed value: a larger private-tag number cannot be a b-value.
LARGEST_CREDIBLE = 5000


def ge_bvalue(value: Column | str) -> Column:
    """First of a backslash list; more than five characters → the last four without leading zeros."""
    first = F.split_part(as_column(value), F.lit("\\"), F.lit(1))
    return F.when(F.length(first) > 5, F.ltrim(F.right(first, F.lit(4)), F.lit("0"))).otherwise(first)


def bytes_bvalue(raw: Column | str, header: Column | str) -> Column:
    """Big-endian bytes → number as text; an unbelievable one gives way to the header value."""
    number = F.conv(F.hex(as_column(raw)), 16, 10)
    return F.when(number.cast("decimal(20,0)") > LARGEST_CREDIBLE, as_column(header)).otherwise(number)


def first_given(columns: Sequence[Column | str]) -> Column:
    """First value that is not the missing mark (NULL counts as missing)."""
    given = [F.nullif(as_column(c), F.lit(MISSING)) for c in columns]
    return F.coalesce(*given, F.lit(MISSING))


def max_token_number(value: Column | str) -> Column:
    """Largest whitespace token as a whole number; other text counts 0, and so does an empty cell.

    Only digits and dots make a number, so a sign or an exponent gives 0, as does ``1.2.3``.
    """
    numbers = F.transform(
        split_blank(value),
        lambda token: F.when(
            token.rlike(r"^([0-9]+\.?[0-9]*|\.[0-9]+)$"), token.try_cast("double")
        ).otherwise(F.lit(0.0)),
    )
    largest = F.coalesce(F.array_max(numbers), F.lit(0.0))
    return F.least(largest, F.lit(2147483647.0)).cast("int")
