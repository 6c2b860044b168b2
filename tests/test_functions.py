"""Column functions on edge cells."""

import pytest
from pyspark.sql import functions as F

from seriesloom.functions import bvalues, ngrams, numbers, text


def cells(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in rows.select("i", make("v").alias("out")).orderBy("i").collect()]


def test_strip_datetimes(spark):
    given = ["t2 1/2/2020 x", "a 10-20-30", "10:20:30", "1/2", None]
    assert cells(spark, given, text.strip_datetimes) == ["t2  x", "a ", "", "1/2", None]


def test_camel_to_snake(spark):
    given = ["EchoTime", "ABCd", "echo_time", ""]
    assert cells(spark, given, text.camel_to_snake) == ["echo_time", "a_b_cd", "echo_time", ""]
    assert cells(spark, ["Echo Time.x-y"], text.normalise_name) == ["echo__time_x_y"]


def test_token_match_is_not_substring(spark):
    def t2(c):
        return text.has_tokens(c, ["t2", "~cor", "~sag"])

    given = ["T2 tse", "t2w", "t2 tra", "t2  SAG", "x"]
    assert cells(spark, given, t2) == [True, False, True, False, False]
    # with a separator given, empty tokens count and other white space does not separate
    assert cells(spark, ["x adc", "x\tadc"], lambda c: text.has_tokens(c, "adc", separator=" ")) == [True, False]
    with pytest.raises(ValueError):
        text.has_tokens("v", "a", how="none")


def test_ge_bvalue(spark):
    given = ["1000000050", "1000000000", "800", "800\\8\\0", "-"]
    assert cells(spark, given, bvalues.ge_bvalue) == ["50", "", "800", "800", "-"]


def test_bytes_bvalue(spark):
    rows = spark.createDataFrame([(bytearray(b"\x03\xe8"),), (bytearray(b"\x00\xff\xff"),)], "b binary")
    out = rows.select(bvalues.bytes_bvalue("b", F.lit("700")).alias("x")).collect()
    assert [r.x for r in out] == ["1000", "700"]


def test_max_token_number(spark):
    given = ["0 500 1000", "1.2.3", "", None, "x 12.7", "-5", "1e3", ".", "99999999999"]
    assert cells(spark, given, bvalues.max_token_number) == [1000, 0, 0, 0, 12, 0, 0, 0, 2147483647]


@pytest.mark.parametrize(
    "cell, expected",
    [
        ("1 2 x", (3, 3, 1, 2, 1.5)),
        ("x y", (2, 0, -1, -1, -1)),
        ("nan 1", (2, -1, 1, 1, -1)),
        ("nan", (1, -1, -1, -1, -1)),
        ("1f", (1, 0, -1, -1, -1)),
        ("1e3", (1, 1000, 1000, 1000, 1000)),
        ("", (1, 0, -1, -1, -1)),
        ("1  2", (3, 3, 1, 2, 1.5)),
        ("-2.5 +1", (2, -1.5, -2.5, 1, -0.75)),
        (None, (-1, -1, -1, -1, -1)),
    ],
)
def test_token_features(spark, cell, expected):
    assert tuple(cells(spark, [cell], numbers.token_features)[0]) == expected


def test_fixed_tokens_reject_another_width(spark):
    assert cells(spark, ["1 2"], lambda c: numbers.fixed_tokens(c, 2)) == [[1.0, 2.0]]
    with pytest.raises(Exception, match="expected 2 numbers"):
        cells(spark, ["1 2 3"], lambda c: numbers.fixed_tokens(c, 2))


def brute_ngrams(words, longest):
    return {" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)}


def test_ngrams_skip_one_letter_words_and_match_brute_force(spark):
    given = ["Ax T2 tse a fs Tra fat sat", "", None, "é x été", "one", "a b c"]
    words = [["ax", "t2", "tse", "fs", "tra", "fat", "sat"], [], [], ["été"], ["one"], []]
    found = cells(spark, given, lambda c: ngrams.word_ngrams(ngrams.word_tokens(c)))
    for grams, tokens in zip(found, words):
        assert len(grams) == len(set(grams))
        assert set(grams) == brute_ngrams(tokens, 5)
    prefixed = cells(spark, ["ab cd"], lambda c: ngrams.word_ngrams(ngrams.word_tokens(c), 2, "k:"))
    assert sorted(prefixed[0]) == ["k:ab", "k:ab cd", "k:cd"]


def test_label_of(spark):
    assert cells(spark, ["0", "1", "7"], lambda c: text.label_of(c, ["adc", "t2"])) == ["ADC", "T2", None]


def test_words_are_whole_runs_of_word_characters(spark):
    """The pattern cuts what one with word boundaries cuts, beside every code point."""
    rows = spark.range(0x110000).where("id not between 55296 and 57343")
    rows = rows.selectExpr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32') AS c")
    rows = rows.selectExpr("concat(c, c, ' a', c, '-', c, 'a ', c, '\\u0301', c, ' x', c, 'y ', c, ' _9', c) AS v")

    def cut(pattern):
        return F.regexp_extract_all("v", F.lit(pattern), 0)

    assert ngrams.WORD != r"(?U)\b\w\w+\b"
    assert rows.where(cut(ngrams.WORD) != cut(r"(?U)\b\w\w+\b")).isEmpty()
