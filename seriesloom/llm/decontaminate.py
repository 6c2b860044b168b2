"""Benchmark decontamination by pigeonhole edit matching.

A test item is in a document if some part of the document is within ``k`` edits of the item, where k is
ERROR_PERCENT of the item's length, both texts with A-Z lower-cased and white space runs made one space.
The item is split into k + 1 pieces; k edits can't touch them all, so one piece occurs unchanged. All
pieces of a block of items are found in one pass over a text by an Aho-Corasick automaton, each hit
marks the window in which the item would lie, and overlapping windows of an item are merged and checked
with Myers' bit-parallel distance (a bit per character of the item, a few integer operations per
character of the window).

The benchmark is a stated query set: it is taken in blocks of at most BLOCK_CHARS characters, each
shipped to all tasks and matched against all documents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ERROR_PERCENT = 5
BLOCK_CHARS = 4_000_000  # characters of items matched at once: bounds what is shipped to a task


def normalise(text: str | None) -> str:
    # on bytes both steps concern ASCII only
    return b" ".join((text or "").encode().lower().split()).decode()


def budget(length: int, percent: int = ERROR_PERCENT) -> int:
    return length * percent // 100


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece) of k + 1 pieces of about equal length; never empty while len(item) > k."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def myers(item: str, text: str, k: int) -> int:
    """Least edit distance between ``item`` and any part of ``text``, or k + 1 if all are above k."""
    m = len(item)
    peq: dict[str, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        # a match may begin anywhere, so nothing is carried into the lowest bit
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best = score
            if best == 0:
                return 0
    return min(best, k + 1)


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: Iterable[tuple[int, str]], percent: int):
        self.items = [(i, t, budget(len(t), percent)) for i, t in items]
        self.pieces = ahocorasick.Automaton()
        for n, (_, item, k) in enumerate(self.items):
            for offset, piece in pieces(item, k):
                self.pieces.get(piece, None) or self.pieces.add_word(piece, [])
                self.pieces.get(piece).append((n, offset, len(piece)))
        if len(self.pieces):
            self.pieces.make_automaton()

    def __call__(self, text: str) -> list[tuple[int, int]]:
        """(item id, distance) of all items in ``text`` (normalised), by id, null ids last."""
        if not len(self.pieces):
            return []
        windows: dict[int, list[tuple[int, int]]] = {}
        exact: dict[int, int] = {}
        for last, owners in self.pieces.iter(text):
            for n, offset, length in owners:
                if n in exact:
                    continue
                _, item, k = self.items[n]
                begin = last + 1 - length - offset
                if begin >= 0 and text.startswith(item, begin):
                    exact[n] = 0
                    continue
                span = (max(begin - k, 0), begin + len(item) + k)
                spans = windows.setdefault(n, [])
                # a piece's hits come in order of their place, so a window can only join a recent one
                if spans and spans[-1][0] <= span[0] <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], max(spans[-1][1], span[1]))
                else:
                    spans.append(span)
        for n, spans in windows.items():
            if n in exact:
                continue
            _, item, k = self.items[n]
            spans.sort()
            merged = [spans[0]]
            for a, b in spans[1:]:
                if a <= merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
                else:
                    merged.append((a, b))
            best = min(myers(item, text[a:b], k) for a, b in merged)
            if best <= k:
                exact[n] = best
        found = ((self.items[n][0], d) for n, d in exact.items())
        return sorted(found, key=lambda x: (x[0] is None, 0 if x[0] is None else x[0], x[1]))


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Normalised items in blocks; a null or blank item matches nothing and is left out."""
    block, size = [], 0
    for row in items.select("item_id", "text").toLocalIterator():
        if text := normalise(row["text"]):
            block.append((row["item_id"], text))
            size += len(text)
            if size >= BLOCK_CHARS:
                yield block
                block, size = [], 0
    if block:
        yield block


def hits_type(items: DataFrame) -> str:
    """Hits carry the items' own kind of id: whole numbers as bigint, all else as text."""
    whole = dict(items.dtypes)["item_id"] in ("tinyint", "smallint", "int", "bigint")
    return f"array<struct<item_id:{'bigint' if whole else 'string'},distance:int>>"


def _match_udf(block: list[tuple[int | str, str]], percent: int, hits: str):
    id_type = pa.int64() if "bigint" in hits else pa.string()
    matchers: list[Matcher] = []  # one per Python worker and plan

    @F.arrow_udf(hits)
    def matched(texts: pa.Array) -> pa.Array:
        if not matchers:
            matchers.append(Matcher(block, percent))
        kind = pa.list_(pa.struct([("item_id", id_type), ("distance", pa.int32())]))
        return pa.array(
            ([{"item_id": i, "distance": d} for i, d in matchers[0](normalise(t))] for t in texts.to_pylist()), kind
        )

    return matched


def match(docs: DataFrame, items: DataFrame, percent: int = ERROR_PERCENT) -> DataFrame:
    """Every row of ``docs`` as struct ``row`` with ``hits``: (item_id, distance) of the items in its text.

    ``items`` has item_id and text. One map over the documents, no shuffle. A null or empty document has
    no hits; a null, empty or blank item is in no document; items with equal texts are hit together and
    repeated documents each have their hits; null ids pass through, of documents and of items; item ids may be
    numbers or text; other columns are left alone. With an
    empty benchmark nothing is hit; an empty table gives an empty result. Texts are searched whole.
    """
    hits = hits_type(items)
    if "string" in hits:
        items = items.withColumn("item_id", F.col("item_id").cast("string"))
    rows = docs.select(F.struct("*").alias("row"), F.array().cast(hits).alias("hits"))
    for block in _blocks(items):
        found = _match_udf(block, percent, hits)(F.col("row.text"))
        rows = rows.select("row", F.concat("hits", found).alias("hits"))
    return rows.select("row", F.array_sort("hits").alias("hits"))


def decontaminate(docs: DataFrame, items: DataFrame, percent: int = ERROR_PERCENT) -> DataFrame:
    """The rows of ``docs`` that hold no test item, with their own columns."""
    return match(docs, items, percent).where(F.size("hits") == 0).select("row.*")
