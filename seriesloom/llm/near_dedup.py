"""Near-duplicate groups from SetSketch registers.

A document's set is its distinct 5-word shingles. Its sketch has REGISTERS registers; register i
holds ``floor(1 - log_B(x))`` cut to 0..Q+1, where x is the least of the exponential variables that hash
function i gives the set's elements. Registers of a union are the element-wise maxima, so sketches of
parts can be merged (``merge_registers``), and two registers agree with about the probability of the
sets' similarity, so they can be banded.

1. One pass over the texts writes (doc_id, set size, 128-bit set fingerprint, registers). Rows with
   equal sets fall into one class; only classes are compared.
2. Classes that agree on all registers of a band meet in that band's bucket. A pair at similarity 0.85
   misses all 40 bands of 5 with probability 7e-11, at 0.8 with 1e-7.
3. The member with most neighbours, in a group of near copies mostly their original, is its bucket's pivot and
   meets all others. Buckets whose members are then all in one component are done.
4. In the others, members of different components may still be linked, and a bucket of many texts that are only
   somewhat similar must not be compared pair by pair. Their full sets are put in one order, rarest shingles
   first. A pair at the threshold shares one of the first n - ceil(threshold * n) + 1 shingles of each set, so a
   set enters only the lists of these, those that no other set has left out, and meets members of other
   components with which the rest of both orders is still long enough. That loses no link, and texts that each
   have a share of shingles of their own meet nobody.
   A meeting is first a maximum-likelihood estimate of the similarity from both register arrays and the
   known set sizes; pairs that come within six standard errors of the threshold are decided on the full
   shingle sets of both texts.
5. Components of the confirmed links give the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.components import connected_components
from seriesloom.llm.store import stored
from seriesloom.llm.words import mix, shingle_sets
from seriesloom.session import materialise

BANDS, ROWS = 40, 5
REGISTERS = BANDS * ROWS
B, A, Q = 1.001, 20.0, 2**16 - 2  # base, rate and range of the registers
_ODD = np.random.default_rng(7).integers(1, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLOCK = 128  # elements handled at once, so their values stay in cache


def registers(elements: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of 64-bit hashes; all 0 for an empty set."""
    if not len(elements):
        return np.zeros(REGISTERS, np.uint16)
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(elements), _BLOCK):
        np.minimum(least, (elements[i : i + _BLOCK, None] * _ODD).min(axis=0), out=least)
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / A
    return np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / np.log(B)), 0, Q + 1).astype(np.uint16)


def merge_registers(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(left, right)


def joint_similarity(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs from their registers (pairs x registers) and sizes.

    The counts of registers that are larger, smaller and equal are multinomial; their probabilities
    follow from the sizes and the similarity. The likelihood is concave and searched by bisection of
    its slope's sign.
    """
    more = (left > right).sum(axis=1)
    less = (left < right).sum(axis=1)
    same = left.shape[1] - more - less
    u = n_left / (n_left + n_right)
    v = 1 - u

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B)

    def likelihood(j):
        p_more, p_less = np.maximum(p(u - v * j), 1e-300), np.maximum(p(v - u * j), 1e-300)
        p_same = np.maximum(1 - p_more - p_less, 1e-300)
        return more * np.log(p_more) + less * np.log(p_less) + same * np.log(p_same)

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(24):
        third = (high - low) / 3
        rises = likelihood(low + third) < likelihood(high - third)
        low, high = np.where(rises, low + third, low), np.where(rises, high, high - third)
    return (low + high) / 2


_SKETCH = "doc_id long, n long, f1 long, f2 long, row_key string, registers binary"


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, f1, f2, kept = [], [], [], []
        for s in shingle_sets(batch.column(2)):
            n.append(len(s))
            f1.append(int(s.sum(dtype=np.uint64)))
            f2.append(int(mix(s ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)))
            kept.append(registers(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).cast(pa.int64()),
                pa.array(n, pa.int64()),
                pa.array(np.array(f1, np.uint64).view(np.int64)),
                pa.array(np.array(f2, np.uint64).view(np.int64)),
                batch.column(1),
                pa.array(kept, pa.binary()),
            ],
            names=["doc_id", "n", "f1", "f2", "row_key", "registers"],
        )


def row_key() -> Column:
    """128 bits of (doc_id, text) as hex digits, nulls told apart from empty texts."""
    text = F.coalesce(F.concat(F.lit("="), F.col("text")), F.lit("-"))
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("|"), text).cast("binary"))


def sketch(docs: DataFrame) -> DataFrame:
    """Set size, set fingerprint and registers (null for an empty set) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), "text")
    return rows.mapInArrow(_sketch_batches, _SKETCH)


def _estimate(threshold: float):
    @F.pandas_udf("double")
    def estimate(ra: pd.Series, rb: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        def matrix(column):
            return np.frombuffer(b"".join(column), np.uint16).reshape(-1, REGISTERS)

        if not len(ra):
            return pd.Series([], dtype="float64")
        return pd.Series(joint_similarity(matrix(ra), matrix(rb), na.to_numpy(float), nb.to_numpy(float)))

    error = (threshold * (1 - threshold) / REGISTERS) ** 0.5
    return estimate, threshold - 6 * error


def _confirm(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first = None, None
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            held = []
            for i, left in enumerate(shingle_sets(batch.column(2))):
                if b[i].as_py() != key:
                    key, first = b[i].as_py(), next(shingle_sets(batch.column(3).slice(i, 1)))
                common = len(np.intersect1d(left, first, assume_unique=True))
                held.append(100 * common >= percent * (len(left) + len(first) - common))
            links = pa.RecordBatch.from_arrays([a, b, batch.column(4)], names=["a", "b", "rank"])
            yield links.filter(pa.array(held, pa.bool_()))

    return confirm


def _links(pairs: DataFrame, classes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, rank) of classes whose sets reach the similarity."""
    sketches = classes.select("class_id", "n", "registers")
    both = pairs.join(sketches.toDF("a", "na", "ra"), "a").join(sketches.toDF("b", "nb", "rb"), "b")
    estimate, least = _estimate(percent / 100)
    near = both.where(estimate("ra", "rb", "na", "nb") >= least).select("a", "b", "rank")
    full = near.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    full = full.select("a", "b", "text_a", "text_b", "rank")
    return full.mapInArrow(_confirm(percent), "a long, b long, rank long")


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, with their component."""
    state = members.join(labels.toDF("class_id", "label"), "class_id", "left").select(
        "bucket", "class_id", "n", F.coalesce("label", "class_id").alias("comp")
    )
    span = state.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    return state.join(stored(span.select("bucket"), "spans", narrow=True), "bucket")


def _pivots(members: DataFrame) -> DataFrame:
    """Of each bucket the member with most neighbours."""
    best = members.groupBy("bucket").agg(F.max(F.struct("near", "class_id", "n")).alias("p"))
    return best.select("bucket", F.col("p.class_id").alias("p"), F.col("p.n").alias("pn"), F.col("p.near").alias("pnear"))


def _pairs(met: DataFrame) -> DataFrame:
    """Distinct pairs (a, b, rank): b is the one with more neighbours, and rank their number."""
    own, other = F.struct("near", "class_id"), F.struct(F.col("pnear").alias("near"), F.col("p").alias("class_id"))
    both = met.select(F.least(own, other).alias("low"), F.greatest(own, other).alias("high"))
    return both.select(
        F.col("low.class_id").alias("a"), F.col("high.class_id").alias("b"), F.col("high.near").alias("rank")
    ).distinct()


_SHINGLES = "class_id long, comp long, n long, shingle long"


def _shingle_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (class_id, comp, n, text) to one row per shingle."""
    for batch in batches:
        for i, s in enumerate(shingle_sets(batch.column(3))):
            for k in range(0, len(s), 1 << 16):
                part = s[k : k + (1 << 16)].view(np.int64)
                own = [pa.array(np.full(len(part), batch.column(c)[i].as_py(), np.int64)) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(part)], names=["class_id", "comp", "n", "shingle"])


def _prefix_pairs(members: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, rank) of ``members`` (class_id, comp, n) of different components that may reach the similarity."""
    sets = texts.join(members, "class_id").select("class_id", "comp", "n", "text").mapInArrow(_shingle_batches, _SHINGLES)
    sets = stored(sets, "shingles")
    counts = stored(sets.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1"), "counts", narrow=True)
    # in the order of all, the shingles that only one set has come first and need no list
    shared = sets.join(counts, "shingle").groupBy("class_id", "comp", "n").agg(
        F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("order")
    )
    alone = F.col("n") - F.size("order")
    length = F.expr(f"n - ({percent} * n + 99) div 100 + 1") - alone
    first = shared.where(length > 0).select(
        "class_id", "comp", "n", alone.alias("alone"), F.posexplode(F.slice("order", F.lit(1), length.cast("int"))).alias("at", "s")
    )
    lists = stored(first.select("s.shingle", "class_id", "comp", "n", (F.col("n") - F.col("alone") - F.col("at")).alias("rest")), "lists", narrow=True)
    several = lists.groupBy("shingle").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    lists = stored(lists.join(several.select("shingle"), "shingle"), "lists", narrow=True)
    other = lists.toDF("shingle", "b", "comp_b", "n_b", "rest_b")
    enough = F.expr(f"{100 + percent} * least(rest, rest_b) >= {percent} * (n + n_b)")
    met = lists.withColumnRenamed("class_id", "a").join(other, "shingle").where((F.col("comp") != F.col("comp_b")) & (F.col("a") < F.col("b")) & enough)
    return met.select("a", "b", F.lit(0).cast("long").alias("rank")).distinct()


def _labels(classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """class_id, label of all classes that are linked with another one."""
    bands = [F.xxhash64(F.lit(i), F.expr(f"substring(registers, {2 * ROWS * i + 1}, {2 * ROWS})")) for i in range(BANDS)]
    members = classes.select("class_id", "n", F.explode(F.array(*bands)).alias("bucket"))
    # counts are tables of their own, so that joins with a very large bucket can be split
    shared = stored(members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "sizes", narrow=True)
    members = stored(members.join(shared, "bucket"), "members", narrow=True)
    near = members.groupBy("class_id").agg(F.sum("size").alias("near"))
    members = stored(members.drop("size").join(near, "class_id"), "members", narrow=True)
    wanted = members.select("class_id").distinct().join(classes.select("class_id", "row_key"), "class_id")
    # rows of one key hold the same text, so any of them serves; repeated rows are combined map-side
    texts = materialise(
        wanted.join(docs.select(row_key().alias("row_key"), "text"), "row_key")
        .groupBy("class_id")
        .agg(F.any_value("text").alias("text")),
        "texts",
    )
    sized = F.expr(f"100 * least(n, pn) >= {percent} * greatest(n, pn)")

    pivots = stored(_pivots(members), "pivots", narrow=True)
    met = members.join(pivots, "bucket").where(sized & (F.col("class_id") != F.col("p")))
    links = stored(_links(_pairs(met), classes, texts, percent), "links", narrow=True)
    labels = connected_components(links)
    # a pivot has met the others of its bucket
    used = pivots.select("bucket", F.col("p").alias("class_id"))
    still = _open(members.join(used, ["bucket", "class_id"], "left_anti"), labels)
    still = stored(still.select("class_id", "comp", "n").distinct(), "open", narrow=True)
    if still.isEmpty():
        return labels
    last = stored(_links(_prefix_pairs(still, texts, percent), classes, texts, percent), "links", narrow=True)
    return labels if last.isEmpty() else connected_components(links.union(last))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Groups of documents linked by ``100 * |intersection| >= percent * |union|`` of their shingle sets.

    Takes doc_id and text from ``docs``; other columns are ignored. Returns one row per input row:
    doc_id, n_shingles, component_id (least doc_id of the group), kept (doc_id = component_id), and
    row_key, by which ``deduplicate`` finds the row again.

    A null text, an empty one and one without words have the empty set, are linked with nothing and are
    their own component. Repeated rows each get a row. A null doc_id is never a component's least id
    unless all ids of the component are null; component_id is null then and the row counts as kept.
    An empty table gives an empty result. Texts are taken whole whatever their length.
    """
    sketches = materialise(sketch(docs), "sketches")
    classes = materialise(
        sketches.where("n > 0")
        .groupBy("f1", "f2", "n")
        .agg(
            F.min("doc_id").alias("first_id"),
            F.min("row_key").alias("row_key"),
            F.any_value("registers").alias("registers"),
        )
        .withColumn("class_id", F.monotonically_increasing_id()),
        "classes",
    )
    labels = _labels(classes, docs, percent)
    labelled = classes.join(labels.toDF("class_id", "label"), "class_id", "left").select(
        "f1", "f2", "n", "first_id", F.coalesce("label", "class_id").alias("label")
    )
    least = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    groups = stored(labelled.join(least, "label").select("f1", "f2", "n", "component_id"), "groups", narrow=True)
    placed = sketches.drop("registers").join(groups, ["f1", "f2", "n"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return placed.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
        "row_key",
    )


def deduplicate(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group the row with the least doc_id.

    All columns stay as they are. Of repeated (doc_id, text) rows one stays. Groups without any id keep
    one row of each distinct (null) id and text.
    """
    kept = near_duplicates(docs, percent).where("kept")
    kept = kept.groupBy("row_key").agg(F.count("*").alias("copies"))
    rows = docs.select(row_key().alias("row_key"), F.struct("*").alias("row"))
    found = rows.join(kept, "row_key")
    once = found.where("copies = 1").select("row")
    again = found.where("copies > 1").groupBy("row_key").agg(F.any_value("row").alias("row")).select("row")
    return once.union(again).select("row.*")
