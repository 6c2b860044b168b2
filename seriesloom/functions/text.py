"""Text cleaning and whole-token tests."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from seriesloom.functions import as_column
from seriesloom.roles import MISSING

# The characters that separate tokens (Unicode white space and ASCII separators).
_BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip_datetimes(value: Column | str) -> Column:
    """Remove digit runs shaped like dates and times (``1/2/2020``, ``1-2-2020``, ``10:20:30``)."""
    out = as_column(value)
    for separator in "/-:":
        out = F.regexp_replace(out, f"[0-9]+{separator}[0-9]+{separator}[0-9]+", "")
    return out


def camel_to_snake(value: Column | str) -> Column:
    """``EchoTime`` → ``echo_time``; every capital but a leading one starts a word."""
    return F.lower(F.regexp_replace(as_column(value), "(?<!^)(?=[A-Z])", "_"))


def normalise_name(value: Column | str) -> Column:
    """Spaces, dots and hyphens become underscores, then snake case."""
    return camel_to_snake(F.translate(as_column(value), " .-", "___"))


def join_list(values: Column | str) -> Column:
    """Array → space-joined text; absent → the missing mark."""
    return F.coalesce(F.array_join(as_column(values), " ", "None"), F.lit(MISSING))


def join_backslashes(value: Column | str) -> Column:
    """Backslash-separated text → space-separated text; absent → the missing mark."""
    return F.coalesce(F.replace(as_column(value), F.lit("\\"), F.lit(" ")), F.lit(MISSING))


def split_blank(value: Column | str) -> Column:
    """Tokens between runs of white space, without empty ones."""
    return F.filter(_split_each_blank(as_column(value)), lambda token: token != "")


def _split_each_blank(value: Column) -> Column:
    """Tokens between single blanks; runs of blanks leave empty tokens."""
    return F.split(F.translate(value, _BLANKS, " " * len(_BLANKS)), " ")


def has_tokens(
    value: Column | str, wanted: str | Iterable[str], how: str = "all", separator: str | None = None
) -> Column:
    """Whole-token test on lower-cased text.

    ``"~adc"`` asks for the token's absence. ``how`` is ``"all"`` or ``"any"``. Tokens lie between
    runs of white space, or between single ``separator`` characters when one is given.
    """
    lowered = F.lower(as_column(value))
    tokens = _split_each_blank(lowered) if separator is None else F.split(lowered, _quote(separator))
    names: Sequence[str] = [wanted] if isinstance(wanted, str) else list(wanted)
    tests = [
        ~F.array_contains(tokens, name[1:]) if name.startswith("~") else F.array_contains(tokens, name)
        for name in names
    ]
    if how not in ("all", "any"):
        raise ValueError(f"how must be 'all' or 'any', not {how!r}")
    return reduce(lambda a, b: a & b if how == "all" else a | b, tests)


def _quote(separator: str) -> str:
    return "\\Q" + separator + "\\E"


def label_of(index: Column | str, labels: Sequence[str]) -> Column:
    """Class index → upper-cased label; an index outside the list gives NULL."""
    choices = F.array(*[F.lit(label) for label in labels])
    return F.upper(F.get(choices, as_column(index).cast("int")))
