"""Column functions. Every one takes a column (or its name) and returns a column; none needs Python workers."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once; an expression used inside a lambda would run per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
