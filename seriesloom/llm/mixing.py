"""Mixing sources to target weights by a Pfair schedule.

Time runs in slots; one block of documents is read per slot. Block i (from 0) of a source with weight w
is released at slot floor(i / w) and due before slot ceil((i + 1) / w); among the released blocks the
one due first takes the slot. With weights that sum to 1 every block meets its deadline, so after any
number of slots a source that has blocks left is less than one block away from its share.

Weights are exact fractions and never rounded, so the schedule does not drift at any length. It is made
by one task that holds a row per source and sends out a row per block, in time of blocks * log(sources);
all else is spread. Documents get their place in their source without a sort of the source: counts per
hash range give the range's offset, and only rows inside a range are ranked. A source that runs out of
blocks leaves its slots; the others keep their windows, so they do not fill up with it. The tables of
sources and slots are joined; Spark measures whether they are small enough to broadcast.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator, Mapping
from fractions import Fraction
from itertools import islice
from math import floor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesloom.session import materialise

PERIOD = 1000  # slots that ``share`` refers to
BLOCK = 8  # documents of a block
RANGE_ROWS = 200  # documents of a hash range, on average


def shares(weights: Mapping[str | None, float], period: int = PERIOD) -> dict[str | None, int]:
    """Whole shares that sum to ``period``, by largest remainder; a source with a weight gets at least 1."""
    if not weights:
        return {}
    if len(weights) > period or any(w <= 0 for w in weights.values()):
        raise ValueError(f"need positive weights of at most {period} sources")
    total = sum(Fraction(w) for w in weights.values())
    exact = {s: Fraction(w) / total * period for s, w in weights.items()}
    out = {s: max(1, floor(x)) for s, x in exact.items()}
    by_rest = sorted(exact, key=lambda s: (out[s] - exact[s], s is None, s or ""))
    k = 0
    while (gap := period - sum(out.values())) != 0:
        s = by_rest[k % len(by_rest)] if gap > 0 else max(out, key=lambda x: (out[x] - exact[x] if out[x] > 1 else -period, x or ""))
        out[s] += 1 if gap > 0 else -1
        k += 1
    return out


def place_blocks(sources: Iterable[tuple[float | Fraction, int]]) -> Iterator[tuple[int, int, int]]:
    """(source number, block, slot) of all blocks by slot: earliest deadline first for (weight, blocks) of each source."""
    sources = list(sources)
    exact = [Fraction(w) for w, _ in sources]
    total = sum(exact)
    over = [(total.numerator * w.denominator, total.denominator * w.numerator) for w in exact]  # 1 / weight
    waiting = [(0, k, 0) for k, (_, blocks) in enumerate(sources) if blocks > 0]  # release, source, block
    ready: list[tuple[int, int, int]] = []  # deadline, source, block
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, k, block = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(block + 1) * over[k][0] // over[k][1]), k, block))
        _, k, block = heapq.heappop(ready)
        yield k, block, slot
        if block + 1 < sources[k][1]:
            heapq.heappush(waiting, ((block + 1) * over[k][0] // over[k][1], k, block + 1))
        slot += 1


def schedule(share: Mapping[str | None, int]) -> dict[str | None, list[int]]:
    """One period of whole shares: the slots of each source's blocks, in order."""
    names = sorted(share, key=lambda s: (s is None, s or ""))
    slots: dict[str | None, list[int]] = {s: [] for s in names}
    for k, _, slot in place_blocks((share[s], share[s]) for s in names):
        slots[names[k]].append(slot)
    return slots


def _place_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(batches).sort_by("source").to_pydict() if (batches := list(batches)) else {"sid": []}
    if not rows["sid"]:
        return
    placed = place_blocks(zip(rows["weight"], rows["blocks"], strict=True))
    while part := list(islice(placed, 100_000)):
        number, block, slot = zip(*part, strict=True)
        columns = [pa.array([rows["sid"][k] for k in number], pa.int64()), pa.array(block, pa.int64()), pa.array(slot, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["_mix_sid", "_mix_block", "_mix_slot"])


def _sources(docs: DataFrame, weights: Mapping[str | None, float] | None, temperature: float, block: int) -> DataFrame:
    """(sid, source, weight, blocks, ranges) of every source of ``docs``."""
    spark = docs.sparkSession
    sized = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        sized = sized.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(float(temperature))))
    else:
        if any(w <= 0 for w in weights.values()):
            raise ValueError("need positive weights")
        given = spark.createDataFrame([(s, float(w)) for s, w in weights.items()], "name string, weight double")
        sized = sized.join(given, F.col("source").eqNullSafe(F.col("name")), "left").drop("name")
    return materialise(
        sized.select(
            F.monotonically_increasing_id().alias("sid"),
            "source",
            "weight",
            F.ceil(F.col("n") / block).alias("blocks"),
            F.ceil(F.col("n") / RANGE_ROWS).alias("ranges"),
        ),
        "sources",
    )


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    temperature: float = 0.5,
    block: int = BLOCK,
    period: int = PERIOD,
) -> DataFrame:
    """Every row of ``docs`` (doc_id, source, ...) with its place in the mix.

    Adds share (the source's exact weight times ``period``), block (of its source, from 0), slot (of the
    block) and position (slot * block size + place in the block): reading by position interleaves the
    sources at the target weights. Columns of these names that ``docs`` already has are replaced; no row
    is dropped or repeated.

    Without ``weights`` a source's weight is its row count to the power ``temperature``. With them every
    source of the table needs one; weights of absent sources count for nothing. A null source is a
    source of its own. Within a source the order is that of a hash of (doc_id, text); equal rows are
    interchangeable and a null doc_id or text is a value like any other. An empty table gives an empty
    result. Sources may be of any number.
    """
    own = [c for c in docs.columns if c.lower() not in ("share", "block", "slot", "position")]
    sources = _sources(docs, weights, temperature, block)
    if missing := [r["source"] for r in sources.where("weight is null").limit(20).collect()]:
        raise ValueError(f"sources without a weight: {missing}")
    slots = sources.select("sid", "source", "weight", "blocks").coalesce(1)
    slots = materialise(slots.mapInArrow(_place_batches, "_mix_sid long, _mix_block long, _mix_slot long"), "slots")
    total = sources.agg(F.sum("weight").alias("w")).first()["w"]
    # names that a table of documents is not expected to have
    sources = sources.select(
        F.col("sid").alias("_mix_sid"),
        F.col("source").alias("_mix_source"),
        F.col("ranges").alias("_mix_ranges"),
        (F.col("weight") / F.lit(total or 1.0) * period).alias("_mix_share"),
    )

    key = F.xxhash64(F.col("doc_id"), F.col("text"))
    names = [F.col(f"`{c}`") for c in own]
    rows = docs.select(*names, key.alias("_mix_key")).join(sources, F.col("source").eqNullSafe(F.col("_mix_source")))
    # equal parts of the hash's span, so a range's rows come before the next range's
    part = F.expr("cast(floor((cast(_mix_key as double) / 18446744073709551616D + 0.5D) * _mix_ranges) as int)")
    part = F.least(F.greatest(part, F.lit(0)), F.col("_mix_ranges") - 1)
    counts = rows.groupBy("_mix_sid", part.alias("_mix_part")).agg(F.count("*").alias("n"))
    before = W.partitionBy("_mix_sid").orderBy("_mix_part").rowsBetween(W.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_mix_offset")
    offsets = materialise(counts.select("_mix_sid", "_mix_part", offset, "n"), "offsets")
    # the slots of a range's blocks go with the range's offset, so that the text needs no shuffle for them
    first, last = F.floor(F.col("_mix_offset") / block), F.floor((F.col("_mix_offset") + F.col("n") - 1) / block)
    of_range = offsets.withColumn("_mix_block", F.explode(F.sequence(first, last))).join(slots, ["_mix_sid", "_mix_block"])
    offsets = of_range.groupBy("_mix_sid", "_mix_part", "_mix_offset").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_mix_block", "_mix_slot"))), lambda x: x["_mix_slot"]).alias("_mix_slots")
    )
    inside = W.partitionBy("_mix_sid", "_mix_part").orderBy("_mix_key", "doc_id")
    placed = rows.select(*names, "_mix_key", "_mix_sid", part.alias("_mix_part"), F.col("_mix_share").alias("share")).withColumn("_mix_rank", F.row_number().over(inside) - 1)
    # ranked rows already lie by the join's keys: the text is shuffled once
    ranked = placed.join(offsets, ["_mix_sid", "_mix_part"])
    ranked = ranked.withColumn("_mix_rank", (F.col("_mix_rank") + F.col("_mix_offset")).cast("long"))
    number = F.floor(F.col("_mix_rank") / block)
    slot = F.get(F.col("_mix_slots"), (number - F.floor(F.col("_mix_offset") / block)).cast("int"))
    return (
        ranked.withColumn("block", number)
        .withColumn("slot", slot)
        .withColumn("position", F.col("slot") * block + F.col("_mix_rank") % block)
        .select(*names, "share", "block", "slot", "position")
    )
