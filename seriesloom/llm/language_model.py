"""Language model by context-tree weighting, and a unigram baseline.

A text is its UTF-8 bytes with A-Z lower-cased, framed by the byte 0xFF, which UTF-8 never uses: DEPTH of
them in front, one behind, so the model is a distribution over whole texts. Each byte is eight binary
decisions, each named by the bits before it. For every decision there is a tree of contexts, the last 0,
1, ... DEPTH bytes; a node holds the counts of zeros and ones seen in training and mixes its own
Krichevsky-Trofimov estimate with its children's product, half and half:

    Pw = (Pkt + Pw(child 1) * Pw(child 2) * ...) / 2,  at the deepest context Pw = Pkt

A new text is scored by the predictive mixture: at every node of the byte's path the estimate counts with
weight Pkt / (2 Pw), the rest comes from the node below. The trained model is fixed, so the cost of a
byte depends on it and the DEPTH bytes before it only, and a text's score is the sum over these grams.

Work on the corpus is Spark's: one pass counts words and grams per task and adds them up in a shuffle. The
nodes of the deepest level are rows (context, decision, zeros, ones); every level above is one grouping of
the one below, from which it gets its counts and the product of its children, and the mixture goes down
again by one join per level. So no task holds a subtree, and all that is gathered grows with the corpus.
Scoring looks frequent words and grams up in tables of bounded size (HOT_WORDS, HOT_GRAMS) shipped
to the tasks; all others go through a join, so the result is exact at any vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma, log
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from seriesloom.llm.store import stored
from seriesloom.llm.words import chunks, word_hashes

DEPTH = 5  # bytes of the longest context; a gram and a decision have to fit a long, so at most 6
FRAME = 255
HOT_WORDS = 500_000  # 16 bytes each
HOT_GRAMS = 1_000_000  # 16 bytes each
SMOOTHING = 0.1
END = np.int64(0x0E4D0F7E47)  # the end token's key

_LOG2 = log(2.0)
_HALVES = 2 * lgamma(0.5)


def held_out(doc_id: Column) -> Column:
    """Documents that are scored but not learnt from; those without an id are learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(10)) == 0, F.lit(False))


def grams(data: np.ndarray, bounds: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Framed grams of depth + 1 bytes of all texts, each as one number with the newest byte lowest, and their bounds by text."""
    n = len(bounds) - 1
    lengths = np.diff(bounds)
    starts = np.arange(n) * (depth + 1) + bounds[:-1] + depth
    framed = np.full(len(data) + n * (depth + 1) + depth, FRAME, np.int64)
    framed[np.arange(len(data)) + np.repeat(starts - bounds[:-1], lengths)] = data
    packed = np.zeros(max(len(framed) - depth, 0), np.int64)
    for k in range(depth + 1):
        packed = (packed << 8) | framed[k : len(framed) - depth + k]
    # a text of n bytes has n + 1 grams that end inside it or on its end; the next ones end in the next frame
    ends = np.append(0, np.cumsum(lengths + 1))
    place = np.arange(ends[-1]) + np.repeat(np.arange(n) * depth, lengths + 1)
    return packed[place], ends


def word_keys(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words, at = word_hashes(data, bounds)
    return words.view(np.int64), at


def _counts(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    unique, place = np.unique(keys, return_inverse=True)
    return unique, np.bincount(place, weights, len(unique)).astype(np.int64)


FLUSH = 64  # chunks whose counts are added up in a task before they are sent on


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["is_word", "key", "n"]

    def send(held: list, is_word: bool) -> pa.RecordBatch:
        keys = np.concatenate([k for k, _ in held])
        key, n = _counts(keys, np.concatenate([c for _, c in held]))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), is_word)), pa.array(key), pa.array(n)], names=names)

    words: list = []
    contexts: list = []
    for batch in batches:
        learnt = batch.column(1).to_numpy(zero_copy_only=False)
        for first, last, data, bounds in chunks(batch.column(0)):
            use = learnt[first:last].astype(bool)
            key, at = word_keys(data, bounds)
            unique, n = np.unique(key[np.repeat(use, np.diff(at))], return_counts=True)
            words.append((np.append(unique, END), np.append(n, use.sum())))
            gram, at = grams(data, bounds)
            mine = np.repeat(use, np.diff(at))
            unique, n = np.unique(gram[mine], return_counts=True)
            contexts.append((unique, n))
            # grams of held-out texts are listed too, with no count: they need a score
            unique = np.unique(gram[~mine])
            contexts.append((unique, np.zeros(len(unique), np.int64)))
            if len(words) >= FLUSH:
                yield send(words, True)
                yield send(contexts, False)
                words, contexts = [], []
    if words:
        yield send(words, True)
        yield send(contexts, False)


def corpus_counts(docs: DataFrame, learnt: Column) -> DataFrame:
    """(is_word, key, n): training counts of words (hash keys; END for the end token) and of grams."""
    rows = docs.select(F.col("text").cast("string").alias("text"), learnt.alias("learnt"))
    parts = rows.mapInArrow(_count_batches, "is_word boolean, key long, n long")
    return parts.groupBy("is_word", "key").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- context trees


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a block with these counts."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _HALVES - _lgamma(zeros + ones + 1.0)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma, by Stirling's series after raising small arguments by 8 (error below 1e-13)."""
    small = np.where(x < 8, x, 1.0)
    rise = np.ones_like(small)
    for k in range(8):
        rise *= small + k
    y = np.where(x < 8, x + 8, x)
    inverse = 1 / (y * y)
    series = (1 / 12 - inverse * (1 / 360 - inverse * (1 / 1260 - inverse * (1 / 1680 - inverse / 1188)))) / y
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + series - np.where(x < 8, np.log(rise), 0.0)


@F.pandas_udf(StructType([StructField("log_w", DoubleType()), StructField("own", DoubleType())]))
def _weigh(zeros: pd.Series, ones: pd.Series, below: pd.Series) -> pd.DataFrame:
    """log Pw of nodes from their counts and their children's log product (null: deepest), and the own estimate's weight."""
    log_own = log_kt(zeros.to_numpy(float), ones.to_numpy(float))
    lower = below.to_numpy(float)
    deepest = np.isnan(lower)
    log_w = np.where(deepest, log_own, np.logaddexp(log_own, np.where(deepest, 0.0, lower)) - _LOG2)
    return pd.DataFrame({"log_w": log_w, "own": np.where(deepest, 1.0, np.exp(log_own - _LOG2 - log_w))})


# sums of these are exact, so runs agree
_EXACT = "decimal(38,12)"


def _decided(counts: DataFrame) -> DataFrame:
    """One row for each gram and decision of its newest byte: key, n, node of the deepest level, bit.

    Decision 1 is the highest bit; decision 2 d + b follows decision d with outcome b. A node is its
    context, the last byte lowest, times 256 plus its decision.
    """
    byte, context = F.col("key").bitwiseAND(255), F.shiftright("key", 8)
    of_byte = F.transform(
        F.sequence(F.lit(0), F.lit(7)),
        lambda k: F.struct(
            F.call_function("shiftright", byte + 256, (8 - k).cast("int")).alias("decision"),
            F.call_function("shiftright", byte, (7 - k).cast("int")).bitwiseAND(1).alias("bit"),
        ),
    )
    rows = counts.where("not is_word").select("key", "n", context.alias("context"), F.explode(of_byte).alias("d"))
    return rows.select("key", "n", (F.col("context") * 256 + F.col("d.decision")).alias("node"), F.col("d.bit").alias("bit"))


def _parent(level: int) -> Column:
    """The node one byte less deep, of a node of ``level``."""
    context = F.shiftright("node", 8).bitwiseAND(F.lit((1 << 8 * (level - 1)) - 1))
    return (context * 256 + F.col("node").bitwiseAND(255)).alias("parent")


def gram_logs(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(key, n, log_p): natural log probability of the newest byte of each gram after the ones before it."""
    decided = _decided(counts)
    sums = [F.sum(F.when(F.col("bit") == b, F.col("n")).otherwise(0)).alias(name) for b, name in ((0, "zeros"), (1, "ones"))]
    level = decided.groupBy("node").agg(*sums).withColumn("below", F.lit(None).cast("double"))
    levels: list[DataFrame] = []
    for length in range(depth, -1, -1):
        weighed = level.select("node", "zeros", "ones", _weigh("zeros", "ones", "below").alias("w"))
        levels.append(stored(weighed.select("node", "zeros", "ones", "w.log_w", "w.own"), "level"))
        if length:
            parts = levels[-1].select(_parent(length), "zeros", "ones", F.col("log_w").cast(_EXACT).alias("log_w"))
            level = parts.groupBy(F.col("parent").alias("node")).agg(
                F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("log_w").cast("double").alias("below")
            )
    estimate = (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1.0)
    above = levels[-1].select("node", (F.col("own") * estimate).alias("p"), (1 - F.col("own")).alias("share"))
    for length in range(1, depth + 1):
        own = levels[depth - length].select("node", _parent(length), "own", estimate.alias("estimate"))
        own = own.join(above.toDF("parent", "p", "share"), "parent")
        above = own.select(
            "node", (F.col("p") + F.col("share") * F.col("own") * F.col("estimate")).alias("p"), (F.col("share") * (1 - F.col("own"))).alias("share")
        )
    log_p = F.log(F.when(F.col("bit") == 1, F.col("p")).otherwise(1 - F.col("p"))).cast(_EXACT)
    cost = decided.join(above.select("node", "p"), "node").groupBy("key").agg(F.max("n").alias("n"), F.sum(log_p).cast("double").alias("log_p"))
    return cost


# ---------------------------------------------------------------- scoring


class Tables(NamedTuple):
    """Frequent words and grams, for lookups inside tasks; plain arrays, so they can be shipped."""

    words: np.ndarray  # sorted keys
    word_counts: np.ndarray
    grams: np.ndarray  # sorted keys
    logs: np.ndarray


def frequent(words: pd.DataFrame, logs: pd.DataFrame) -> Tables:
    order, by_gram = np.argsort(words["key"].to_numpy()), np.argsort(logs["key"].to_numpy())
    return Tables(
        words["key"].to_numpy()[order], words["n"].to_numpy()[order], logs["key"].to_numpy()[by_gram], logs["log_p"].to_numpy()[by_gram]
    )


def at_least(counts: DataFrame, most: int) -> int:
    """The least power of two that at most ``most`` of the counts ``n`` reach: few numbers decide, whatever the table's size."""
    powers = counts.where("n > 0").groupBy(F.floor(F.log2("n")).alias("power")).agg(F.count("*").alias("rows"))
    found = {row.power: row.rows for row in powers.collect()}
    power, reach = max(found, default=0) + 1, 0
    while power > 0 and reach + found.get(power - 1, 0) <= most:
        power -= 1
        reach += found.get(power, 0)
    return 1 << power


def _log_of(tables: Tables, gram: np.ndarray) -> np.ndarray:
    """log probabilities, NaN where the gram is no frequent one."""
    if not len(tables.grams):
        return np.full(len(gram), np.nan)
    unique, place = np.unique(gram, return_inverse=True)
    at = np.minimum(np.searchsorted(tables.grams, unique), len(tables.grams) - 1)
    return np.where(tables.grams[at] == unique, tables.logs[at], np.nan)[place]


def _count_of(tables: Tables, word: np.ndarray) -> np.ndarray:
    """Training counts, -1 where the word is no frequent one."""
    if not len(tables.words):
        return np.full(len(word), -1, np.int64)
    at = np.minimum(np.searchsorted(tables.words, word), len(tables.words) - 1)
    return np.where(tables.words[at] == word, tables.word_counts[at], -1)


SCORED = (
    "row_id long, doc_id long, held_out boolean, n_bytes long, n_tokens long, n_known long, base double, logs double, "
    "rest array<struct<is_word:boolean,key:bigint,times:bigint>>"
)


def _rest(text: np.ndarray, is_word: np.ndarray, key: np.ndarray, n: int) -> pa.Array:
    """(is_word, key, times) of the keys left over, as one list per text."""
    order = np.lexsort((key, is_word, text))
    text, is_word, key = text[order], is_word[order], key[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (is_word[1:] != is_word[:-1]) | (key[1:] != key[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(text)))
    entries = pa.StructArray.from_arrays(
        [pa.array(is_word[at]), pa.array(key[at]), pa.array(times)], names=["is_word", "key", "times"]
    )
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(text[at], np.arange(n + 1)).astype(np.int32)), entries)


def _score_batches(tables, scale: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known = Tables(*tables.value)
        row = TaskContext.get().partitionId() << 40
        names = ["row_id", "doc_id", "held_out", "n_bytes", "n_tokens", "n_known", "base", "logs", "rest"]
        for batch in batches:
            for first, last, data, bounds in chunks(batch.column(0)):
                n = last - first
                key, word_at = word_keys(data, bounds)
                gram, gram_at = grams(data, bounds)
                of_word = np.repeat(np.arange(n), np.diff(word_at))
                of_gram = np.repeat(np.arange(n), np.diff(gram_at))
                unique, place = np.unique(key, return_inverse=True)  # each distinct word is looked up once
                seen = _count_of(known, unique)
                base = np.where(seen < 0, 0.0, np.log10((np.maximum(seen, 0) + SMOOTHING) / scale))[place]
                count = seen[place]
                log_p = _log_of(known, gram)
                odd = np.isnan(log_p)
                rare = count < 0
                rest = _rest(
                    np.concatenate([of_word[rare], of_gram[odd]]),
                    np.concatenate([np.ones(rare.sum(), bool), np.zeros(odd.sum(), bool)]),
                    np.concatenate([key[rare], gram[odd]]),
                    n,
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + np.arange(n)),
                        batch.column(1).slice(first, n),
                        batch.column(2).slice(first, n),
                        pa.array(np.diff(bounds)),
                        pa.array(np.diff(word_at) + 1),
                        pa.array(np.bincount(of_word, count > 0, n).astype(np.int64)),
                        pa.array(np.bincount(of_word, base, n)),
                        pa.array(np.bincount(of_gram, np.where(odd, 0.0, log_p), n)),
                        rest,
                    ],
                    names=names,
                )
                row += n

    return score


def score_documents(docs: DataFrame, hot_words: int = HOT_WORDS, hot_grams: int = HOT_GRAMS) -> DataFrame:
    """Learn from the documents that are not held out and score all of them.

    Takes doc_id and text; other columns are ignored. Returns doc_id, held_out, n_tokens (words and one
    end), n_known (tokens seen in training), train_tokens, base_score (add-0.1 unigram log10 probability),
    score (log10 probability under the weighted context trees), bits_per_byte (its code length; the end
    counts as a byte). A null text is an empty one: one token, the end. A null doc_id is not held out. Repeated
    rows are learnt from and scored each. An empty table gives an empty result; without any training
    document nothing is known and every decision has even odds.
    """
    spark = docs.sparkSession
    rows = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"))
    out = held_out(F.col("doc_id"))
    counts = stored(corpus_counts(rows, ~out), "counts")
    words = counts.where("is_word")
    train = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("v")).first()
    total, vocabulary = train["n"], train["v"]
    scale = total + SMOOTHING * (vocabulary + 1)
    logs = stored(gram_logs(counts), "gram_logs")

    end = words.where(F.col("key") == F.lit(int(END))).select("n").first()
    end_count = end["n"] if end else 0
    others = words.where(F.col("key") != F.lit(int(END)))
    hot = others.where(F.col("n") >= at_least(others, hot_words)).select("key", "n").toArrow().to_pandas()
    hot_logs = logs.where(F.col("n") >= at_least(logs, hot_grams)).select("key", "log_p").toArrow().to_pandas()
    tables = spark.sparkContext.broadcast(tuple(frequent(hot, hot_logs)))

    scored = rows.select(F.col("text").cast("string").alias("text"), "doc_id", out.alias("held_out"))
    scored = stored(scored.mapInArrow(_score_batches(tables, scale), SCORED), "scored")
    rest = scored.select("row_id", F.explode("rest").alias("r")).select("row_id", "r.*")
    rare = rest.where("is_word").join(words.select("key", "n"), "key", "left")
    n = F.coalesce("n", F.lit(0))
    of_words = rare.select(
        "row_id",
        F.when(n > 0, F.col("times")).otherwise(F.lit(0)).alias("known"),
        (F.col("times") * F.log10((n + SMOOTHING) / F.lit(float(scale)))).alias("base"),
        F.lit(0.0).alias("logs"),
    )
    of_grams = rest.where("not is_word").join(logs.select("key", "log_p"), "key").select(
        "row_id", F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base"), (F.col("times") * F.col("log_p")).alias("logs")
    )
    more = of_words.union(of_grams).groupBy("row_id").agg(
        F.sum("known").alias("more_known"), F.sum("base").alias("more_base"), F.sum("logs").alias("more_logs")
    )
    end_log = float(np.log10((end_count + SMOOTHING) / scale))
    score = (F.col("logs") + F.coalesce("more_logs", F.lit(0.0))) / float(np.log(10))
    return (
        scored.drop("rest")
        .join(more, "row_id", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("n_known") + F.coalesce("more_known", F.lit(0)) + (1 if end_count else 0)).cast("long").alias("n_known"),
            F.lit(int(total)).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("more_base", F.lit(0.0)) + F.lit(end_log)).alias("base_score"),
            score.alias("score"),
            (-score * float(np.log2(10)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
        )
    )
