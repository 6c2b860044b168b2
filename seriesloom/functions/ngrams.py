"""Word tokens and word n-grams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from seriesloom.functions import as_column, let

# Fixed value: a token is a whole run of two or more word characters (Unicode). ASCII ones stand first, as the class is
# tested from left to right and the Unicode property is the slow part; nothing is given back at a run's end.
WORD = r"(?U)[0-9A-Z_a-z[\w&&[^\x00-\x7F]]]{2,}+"


def word_tokens(value: Column | str, pattern: str = WORD) -> Column:
    """Lower-cased word tokens; NULL text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(as_column(value), F.lit(""))), F.lit(pattern), 0)


def word_ngrams(tokens: Column | str, longest: int = 5, prefix: str = "") -> Column:
    """Distinct n-grams of 1 to ``longest`` words, words joined by one space, behind a fixed ``prefix``.

    Every n-gram is the (n-1)-gram at its place with one more word.
    """

    def all_grams(words: Column) -> Column:
        def extend(found: list[Column]) -> Column:
            n = len(found) + 1
            done = F.array_distinct(F.concat(*found))
            if n > longest:
                return done
            count = F.size(words) - F.lit(n - 1)
            grams = F.zip_with(
                F.slice(found[-1], F.lit(1), count),
                F.slice(words, F.lit(n), count),
                lambda gram, word: F.concat(gram, F.lit(" "), word),
            )
            # header cells are short: stop where no longer n-gram exists
            return F.when(count <= 0, done).otherwise(let(grams, lambda longer: extend([*found, longer])))

        if not prefix:
            return extend([words])
        return let(F.transform(words, lambda word: F.concat(F.lit(prefix), word)), lambda w: extend([w]))

    return let(as_column(tokens), all_grams)


def placed_words(tokens: Column | str) -> Column:
    """Words with their places: the 1-grams that ``longer_ngrams`` starts from."""
    return F.transform(as_column(tokens), lambda word, at: F.struct(at.alias("at"), word.alias("gram")))


def longer_ngrams(grams: Column | str, frequent: Callable[[Column], Column]) -> Column:
    """From some n-grams of a text (structs of place and gram, by place) the (n+1)-grams both of whose n-grams are ``frequent``."""

    def extend(kept: Column) -> Column:
        count = F.greatest(F.size(kept) - 1, F.lit(0))

        def joined(a: Column, b: Column) -> Column:
            word = F.substring_index(b["gram"], " ", -1)
            longer = F.struct(a["at"].alias("at"), F.concat(a["gram"], F.lit(" "), word).alias("gram"))
            return F.when(b["at"] == a["at"] + 1, longer)

        return F.zip_with(F.slice(kept, F.lit(1), count), F.slice(kept, F.lit(2), count), joined)

    return F.array_compact(let(F.filter(as_column(grams), lambda x: frequent(x["gram"])), extend))
