"""Removal of byte passages that occur more than once, by run-length compressed indexes.

A byte goes if a string of LENGTH bytes that covers it also starts at any other place of the corpus, its own
document included. Every such string (*window*) is compared with all that could equal it, without a pair of
documents ever being formed:

1. A window's *anchor* is its GRAM-byte string of least hash, the leftmost of equals. Consecutive windows of
   a document with the same anchor form a *segment*. Equal windows have equal anchors at equal places, so
   only segments of one anchor can share a window. One pass over the texts writes a row per segment: its
   place, its anchor's hash and a hash of its bytes (equal ones that follow each other, as in periodic text,
   are one row).
2. Segments whose anchor occurs once are done. Where all segments of an anchor are equal, all their windows
   repeat. Only anchors with different segments need bytes: one copy of each different segment is fetched.
3. The fetched segments are packed by anchor into blocks of about BLOCK bytes. Over each block a suffix order
   gives the Burrows-Wheeler transform, which is cut into runs; match lengths are taken at both ends of each
   run only (there the sampled suffixes stand) and are streamed over the text from there: away from a run's
   end the neighbour of a suffix moves along with it and the match is one byte shorter. Windows whose longest
   match with any other suffix reaches LENGTH repeat.
4. An anchor with more than GROUP different segments (a very common passage in different surroundings) is cut
   into cells of fewer windows, keyed by the anchor, the cell and the bytes that all windows of the cell
   share, and equal pieces are combined; what is still large is cut again, down to single windows, which are
   decided by their count. So no group has to fit a task, and nothing is sampled or dropped.
5. Repeated windows are merged to spans per document and the spans are cut out.

Odd rows: a null text counts as empty; texts under LENGTH bytes hold no window and stay as they are. Repeated
rows count as occurrences of each other. Null and repeated doc_ids are allowed (rows are told apart by
doc_id and text; rows equal in both share their spans). An empty table gives an empty result. Very long texts
are worked off in pieces. Other columns, whatever their names, are carried along in ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.store import stored
from seriesloom.llm.words import mix

LENGTH = 400  # bytes of a window
GRAM = 32  # bytes of an anchor
SLOTS = LENGTH - GRAM + 1  # places of an anchor in a window
PIECE = 1 << 20  # bytes handled at once; longer texts are cut into overlapping pieces
PLACE_BITS = 22  # of a place in a piece, under the hash
BLOCK = 1 << 18  # bytes of an index
GROUP = 200  # different segments of an anchor that go to one task
CELLS = (48, 6, 1)  # windows of a cell, turn by turn

_RANDOM = np.random.default_rng(11)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = int(_RANDOM.integers(1, 2**62, dtype=np.uint64)) | 1
_LOW = np.uint64((1 << PLACE_BITS) - 1)
_TOP = np.iinfo(np.uint64).max


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.append(np.uint64(1), np.full(n - 1, base, np.uint64)), dtype=np.uint64)


class _Scale:
    """Powers of the hash base and of its inverse, made once per process."""

    up = down = np.zeros(0, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 2**64), n)
        return cls.up[:n], cls.down[:n]


# ---------------------------------------------------------------- segments


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``data`` (bytes) the place of its anchor, and the hashes of all grams."""
    n = len(data)
    up, down = _Scale.of(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up, out=sums[1:])
    hashes = mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    m = len(hashes)
    packed = np.full(-(-m // SLOTS) * SLOTS, _TOP, np.uint64)
    packed[:m] = (hashes & ~_LOW) | np.arange(m, dtype=np.uint64)
    blocks = packed.reshape(-1, SLOTS)
    upto = np.minimum.accumulate(blocks, axis=1).ravel()
    since = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(since[: m - SLOTS + 1], upto[SLOTS - 1 : m])
    return (least & _LOW).astype(np.int64), hashes


def segments(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First windows, window counts, anchor places and anchor hashes of the segments of texts ``data[bounds[i]:bounds[i + 1]]``."""
    if len(data) < LENGTH:
        nothing = np.zeros(0, np.int64)
        return nothing, nothing, nothing, nothing.astype(np.uint64)
    place, hashes = anchors(data)
    n = len(place)
    long = np.flatnonzero(np.diff(bounds) >= LENGTH)
    opens, ends = bounds[long], bounds[long + 1] - LENGTH + 1
    inside = np.zeros(n + 1, np.int32)
    np.add.at(inside, opens, 1)
    np.add.at(inside, ends, -1)
    edge = np.zeros(n + 1, bool)
    edge[1:n] = place[1:] != place[:-1]
    edge[opens] = edge[ends] = True
    edges = np.flatnonzero(edge)
    first = np.cumsum(inside)[edges] > 0
    starts, counts = edges[first], (np.append(edges[1:], n) - edges)[first]
    return starts, counts, place[starts], hashes[place[starts]]


def _pieces(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, offset in its text, bytes, bounds): whole texts up to PIECE bytes together, or a piece of a longer one."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if n == 0:
        return
    bounds = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        last = max(int(np.searchsorted(bounds, bounds[row] + PIECE, "right")) - 1, row + 1)
        low, high = int(bounds[row]), int(bounds[last])
        if high - low <= PIECE:
            yield row, 0, data[low:high], bounds[row : last + 1] - low
        else:
            for at in range(low, high - LENGTH + 1, PIECE):
                part = data[at : min(at + PIECE + LENGTH - 1, high)]
                yield row, at - low, part, np.array([0, len(part)])
        row = last


_SEGMENT = "k1 long, k2 long, start long, windows int, times int, lead int, anchor long, content long"


def _segment_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]
        for row, offset, data, bounds in _pieces(batch.column(2)):
            starts, counts, places, hashes = segments(data, bounds)
            if not len(starts):
                continue
            view = memoryview(np.ascontiguousarray(data))
            ends = starts + counts + LENGTH - 1
            content = np.array([xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64)
            owner = np.searchsorted(bounds, starts, "right") - 1
            # runs of equal segments one after the other
            fresh = np.ones(len(starts), bool)
            fresh[1:] = (content[1:] != content[:-1]) | (counts[1:] != counts[:-1]) | (owner[1:] != owner[:-1]) | (starts[1:] != starts[:-1] + counts[:-1])
            first = np.flatnonzero(fresh)
            times = np.diff(np.append(first, len(starts)))
            owner = owner[first]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys[0][row + owner]),
                    pa.array(keys[1][row + owner]),
                    pa.array(starts[first] - bounds[owner] + offset),
                    pa.array(counts[first].astype(np.int32)),
                    pa.array(times.astype(np.int32)),
                    pa.array((places - starts)[first].astype(np.int32)),
                    pa.array(hashes[first].view(np.int64)),
                    pa.array(content[first].view(np.int64)),
                ],
                names=[c.split()[0] for c in _SEGMENT.split(", ")],
            )


# ---------------------------------------------------------------- index


class RunIndex:
    """Run-length compressed Burrows-Wheeler transform of byte strings, with match lengths sampled at the ends of its runs.

    The strings stand one after the other, each followed by a separator that is no byte.
    """

    def __init__(self, strings: list[bytes]):
        sizes = np.array([len(s) + 1 for s in strings], np.int64)
        self.ends = np.cumsum(sizes) - 1
        self.starts = self.ends + 1 - sizes
        n = int(sizes.sum())
        self.symbols = np.zeros(n, np.int64)
        inner = np.ones(n, bool)
        inner[self.ends] = False
        self.symbols[inner] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + 1
        self.ranks: list[tuple[int, np.ndarray]] = []
        order = self._sort()
        # the transform: the symbol before each suffix; a run ends where the next symbol differs, or at a string's start
        before = np.roll(self.symbols, 1)
        before[self.starts] = -1 - np.arange(len(strings))
        column = before[order]
        breaks = np.flatnonzero(column[1:] != column[:-1])
        self.n_runs = len(breaks) + 1
        self.head, self.tail = order[np.append(0, breaks + 1)], order[np.append(breaks, n - 1)]
        match = self._match(order[breaks], order[breaks + 1])
        self.head_match, self.tail_match = np.append(0, match), np.append(match, 0)

    def _sort(self) -> np.ndarray:
        """The order of all suffixes by doubling; ``ranks`` keeps the order by the first 7, 14, 28 ... symbols.

        A rank is the first place of a suffix's group in the order; only groups of several are sorted again.
        """
        n, step = len(self.symbols), 7
        padded = np.append(self.symbols, np.zeros(step, np.int64))
        key = np.zeros(n, np.int64)
        for j in range(step):  # nine bits a symbol
            key = (key << 9) | padded[j : j + n]
        order, rank, places = np.argsort(key), np.empty(n, np.int64), np.arange(n)
        members, key = order, key[order]
        while True:
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            sizes = np.diff(np.append(first, len(key)))
            rank = rank.copy()
            rank[members] = np.repeat(places[first], sizes)
            self.ranks.append((step, np.append(rank, -1)))
            places = places[np.repeat(sizes, sizes) > 1]
            if not len(places):
                return order
            members = order[places]
            key = rank[members] * (n + 1) + self.ranks[-1][1][np.minimum(members + step, n)] + 1
            sort = np.argsort(key)
            members, key = members[sort], key[sort]
            order[places] = members
            step *= 2

    def _match(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Common prefix lengths of the suffixes at p and q."""
        n, length = len(self.symbols), np.zeros(len(p), np.int64)
        for step, rank in reversed(self.ranks):
            a, b = np.minimum(p + length, n), np.minimum(q + length, n)
            length += np.where(rank[a] == rank[b], step, 0)
        symbols, going = np.append(self.symbols, -1), np.ones(len(p), bool)
        for _ in range(6):
            going &= symbols[np.minimum(p + length, n)] == symbols[np.minimum(q + length, n)]
            length += going
        return length

    def longest(self) -> np.ndarray:
        """For each place the length of the longest match of its suffix with any other one, up to its string's end.

        Streamed from the run ends: elsewhere the neighbour in the order moves along with the suffix.
        """
        n = len(self.symbols)
        best, here = np.zeros(n, np.int64), np.arange(n)
        for sample, match in ((self.head, self.head_match), (self.tail, self.tail_match)):
            at, length = np.zeros(n, np.int64), np.zeros(n, np.int64)
            at[sample] = sample
            at = np.maximum.accumulate(at)
            length[sample] = match
            best = np.maximum(best, length[at] - (here - at))
        return np.minimum(best, np.repeat(self.ends, self.ends - self.starts + 1) - here)


def repeated_windows(strings: list[bytes]) -> list[list[tuple[int, int]]]:
    """For each string the ranges [from, to) of windows that occur elsewhere in the strings."""
    index = RunIndex(strings)
    hit = index.longest() >= LENGTH
    found: list[list[tuple[int, int]]] = [[] for _ in strings]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        owner = int(np.searchsorted(index.starts, a, "right")) - 1
        found[owner].append((a - int(index.starts[owner]), b - int(index.starts[owner])))
    return found


_FOUND = "content long, anchor long, ranges array<struct<low:int,high:int>>"


def _index_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, content, bytes) sorted by anchor: whole anchors are packed into blocks."""

    def flush(block):
        rows = [(c, a, [{"low": x, "high": y} for x, y in r]) for (a, c), r in zip(block, repeated_windows(list(block.values())), strict=True) if r]
        names = ["content", "anchor", "ranges"]
        types = [pa.int64(), pa.int64(), pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))]
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    block: dict[tuple[int, int], bytes] = {}  # repeated rows of the corpus bring a segment more than once
    size, last = 0, None
    for batch in batches:
        for anchor, content, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if anchor != last and size >= BLOCK:
                yield flush(block)
                block, size = {}, 0
            last = anchor
            if (anchor, content) not in block:
                block[anchor, content] = data
                size += len(data)
    if block:
        yield flush(block)


# ---------------------------------------------------------------- Spark


def _hash64(value: Column, first: int) -> Column:
    return F.conv(F.substring(value, first, 16), 16, -10).cast("long")


def row_keys() -> list[Column]:
    """128 bits of (doc_id, text), as two longs."""
    whole = F.md5(
        F.concat(
            F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("|"), F.coalesce(F.concat(F.lit("="), F.col("text")), F.lit("-"))
        )
    )
    return [_hash64(whole, 1).alias("k1"), _hash64(whole, 17).alias("k2")]


_PART = "anchor long, content long, times long, kinds long, lead int, data binary"


def _fetch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k1, k2, text, wanted segments) to the segments' bytes."""
    last = None
    for batch in batches:
        out = []
        for k1, k2, text, wanted in zip(*(batch.column(i) for i in range(4)), strict=True):
            key = k1.as_py(), k2.as_py()
            if key == last:
                continue  # a repeated row
            last, data = key, text.as_buffer()
            for w in wanted.as_py():
                part = data.slice(w["start"], w["windows"] + LENGTH - 1).to_pybytes()
                out.append((w["anchor"], w["content"], w["times"], w["kinds"], w["lead"], part))
        if out:
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(map(list, zip(*out, strict=True)), types, strict=True)], names=[c.split()[0] for c in _PART.split(", ")]
            )


_CELL = "content long, anchor long, low int, part_anchor long, part_content long, lead int, data binary"


def _cell_batches(width: int):
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for anchor, content, lead, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                least = lead - (len(data) - LENGTH)  # distance from the last window to the anchor
                for cell in range(least // width, lead // width + 1):
                    far, near = min(lead, cell * width + width - 1), max(least, cell * width)
                    part = data[lead - far : lead - near + LENGTH]
                    # what all windows of a full cell hold
                    core = data[lead - cell * width : lead - (cell * width + width - 1) + LENGTH]
                    key = xxhash.xxh3_64_intdigest(core + cell.to_bytes(4, "big") + anchor.to_bytes(8, "big", signed=True))
                    out.append((content, anchor, lead - far, key - (key >> 63 << 64), _signed(xxhash.xxh3_64_intdigest(part)), far, part))
            if out:
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(map(list, zip(*out, strict=True)), types, strict=True)], names=[c.split()[0] for c in _CELL.split(", ")]
                )

    return cells


def _signed(x: int) -> int:
    return x - (x >> 63 << 64)


def _ranges(parts: DataFrame, cells: tuple[int, ...]) -> DataFrame:
    """content, anchor, ranges of repeated windows of different ``parts`` (as _PART, ``kinds`` being how many share the anchor, at most)."""
    count = (F.octet_length("data") - (LENGTH - 1)).alias("high")
    whole = F.array(F.struct(F.lit(0).alias("low"), count)).alias("ranges")
    full = parts.where("times > 1").select("content", "anchor", whole)
    if not cells:  # single windows: equal ones have been counted
        return full
    small = parts.where((F.col("kinds") > 1) & (F.col("kinds") <= GROUP))
    # by an expression: plain "anchor" is dropped after a join on it, whose tasks may each hold a part of a skewed anchor
    small = small.select("anchor", "content", "data").repartition(F.xxhash64("anchor")).sortWithinPartitions("anchor")
    once = parts.where("times = 1").select("content", "anchor")
    found = small.mapInArrow(_index_batches, _FOUND).join(once, ["content", "anchor"], "left_semi")
    found = full.union(found.select("content", "anchor", "ranges"))
    hot = parts.where((F.col("kinds") > GROUP)).dropDuplicates(["anchor", "content"])
    if hot.isEmpty():
        return found
    split = stored(hot.select("anchor", "content", "lead", "data").mapInArrow(_cell_batches(cells[0]), _CELL), "cells", narrow=True)
    counted = hot.select("anchor", "content", "times")
    merged = split.join(counted, ["anchor", "content"]).groupBy("part_anchor", "part_content").agg(
        F.sum("times").alias("times"), F.any_value("lead").alias("lead"), F.any_value("data").alias("data")
    )
    merged = stored(merged.withColumnsRenamed({"part_anchor": "anchor", "part_content": "content"}), "parts", narrow=True)
    kinds = stored(merged.groupBy("anchor").agg(F.count("*").alias("kinds")), "kinds", narrow=True)
    deeper = _ranges(merged.join(kinds, "anchor"), cells[1:])
    deeper = deeper.withColumnsRenamed({"anchor": "part_anchor", "content": "part_content"})
    moved = F.transform(
        "ranges", lambda r: F.struct((r["low"] + F.col("low")).alias("low"), (r["high"] + F.col("low")).alias("high"))
    )
    places = split.select("content", "anchor", "low", "part_anchor", "part_content")
    return found.union(places.join(deeper, ["part_anchor", "part_content"]).select("content", "anchor", moved.alias("ranges")))


_SPANS = "k1 long, k2 long, spans array<struct<low:long,high:long>>"


def _merge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlapping and touching ranges of each row become one."""
    for batch in batches:
        merged = []
        for ranges in batch.column(2):
            values = ranges.values
            low, high = values.field(0).to_numpy(), values.field(1).to_numpy()
            order = np.argsort(low, kind="stable")
            low, high = low[order], np.maximum.accumulate(high[order])
            first = np.append(True, low[1:] > high[:-1])
            merged.append([{"low": a, "high": b} for a, b in zip(low[first].tolist(), high[np.append(first[1:], True)].tolist(), strict=True)])
        kind = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(merged, kind)], names=["k1", "k2", "spans"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """k1, k2 (``row_keys`` of doc_id and text) and the byte spans of a row that are to go, for rows that have any."""
    texts = docs.select("doc_id", "text").where(F.octet_length("text") >= LENGTH).select(*row_keys(), "text")
    own = stored(texts.mapInArrow(_segment_batches, _SEGMENT), "segments")
    anchors_ = own.groupBy("anchor").agg(
        F.sum("times").alias("total"), F.min("content").alias("least"), F.max("content").alias("most")
    )
    anchors_ = anchors_.where("total > 1").select("anchor", "total", (F.col("least") != F.col("most")).alias("mixed"))
    # as a table of its own, so that the join with a very common anchor can be split
    shared = stored(own.join(stored(anchors_, "anchors", narrow=True), "anchor"), "shared")
    mixed = shared.where("mixed")
    different = mixed.groupBy("anchor", "content").agg(
        F.sum("times").alias("times"),
        *[F.any_value(c).alias(c) for c in ("k1", "k2", "start", "windows", "lead", "total")],
    )
    wanted = different.groupBy("k1", "k2").agg(
        F.collect_list(F.struct("start", "windows", "anchor", "content", "times", F.col("total").alias("kinds"), "lead")).alias("wanted")
    )
    parts = texts.join(stored(wanted, "wanted", narrow=True), ["k1", "k2"])
    parts = parts.select("k1", "k2", "text", "wanted").mapInArrow(_fetch_batches, _PART)
    found = _ranges(stored(parts, "parts"), CELLS).select("anchor", "content", F.explode("ranges").alias("r"))
    here = mixed.join(stored(found, "ranges", narrow=True), ["anchor", "content"]).select("k1", "k2", "start", "windows", "times", "r.low", "r.high")
    alike = shared.where("not mixed").select("k1", "k2", "start", "windows", "times", F.lit(0).alias("low"), F.col("windows").alias("high"))
    # equal segments one after the other repeat as a whole
    last = F.col("start") + F.when(F.col("times") > 1, F.col("times").cast("long") * F.col("windows")).otherwise(F.col("high")) + (LENGTH - 1)
    ranges = here.union(alike).select("k1", "k2", (F.col("start") + F.col("low")).alias("low"), last.alias("high")).distinct()
    rows = ranges.groupBy("k1", "k2").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    return rows.mapInArrow(_merge_batches, _SPANS)


def strip_repeats(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` as ``row``, with ``spans`` (removed byte ranges, in order) and ``kept`` (the other bytes)."""
    spans = stored(repeated_spans(docs), "spans", narrow=True)
    rows = docs.select(*row_keys(), F.struct("*").alias("row")).join(spans, ["k1", "k2"], "left")
    data = F.coalesce(F.col("row.text"), F.lit("")).cast("binary")
    rows = rows.select("row", F.coalesce("spans", F.array().cast("array<struct<low:long,high:long>>")).alias("spans"), data.alias("data"))

    def gap(i: Column) -> Column:
        """The bytes between two spans, as hex digits."""
        low = F.coalesce(F.get("spans", i - 1)["high"], F.lit(0))
        high = F.coalesce(F.get("spans", i)["low"], F.octet_length("data").cast("long"))
        return F.hex(F.substring("data", (low + 1).cast("int"), (high - low).cast("int")))

    gaps = F.transform(F.sequence(F.lit(0), F.size("spans")), gap)
    kept = F.when(F.size("spans") == 0, F.col("data")).otherwise(F.unhex(F.array_join(gaps, "")))
    return rows.select("row", "spans", kept.alias("kept"))
