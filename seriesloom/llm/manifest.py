"""A Merkle manifest of a document table as postorder append logs.

Every document is a leaf; the leaves of a source, ordered by doc_id, carry a tree in which FAN consecutive
nodes have one parent, and the subroots of the sources, ordered by source, carry one more tree up to the root.

A tree is kept as a log of its nodes in the order of their completion (postorder). Where a node stands in
the log follows from the sizes of the subtrees before it alone (``position``), so nothing has to be looked
up to address it. Builders are aligned: one takes SPAN consecutive nodes, completes two levels above them
and writes what it has completed in that order; the nodes of its upper level are input of the next turn's
builders. A source with a third of all rows is thus built by as many groups as it has blocks of SPAN
leaves, and the number of turns is the logarithm of the leaf count to the base SPAN.

Proofs are taken from the log from the top down: a block of SPAN nodes gets the path above it once, and the
siblings of each of its nodes are fetched by their closed-form positions.

Odd rows: a null in any column is the mark ``-`` in the leaf; null doc_ids come first in their source, rows
of equal doc_id by their digest, and repeated rows each are a leaf. A null source is a source of its own,
before all others. Empty and very long texts are hashed whole. An empty table gives an empty manifest.
Columns other than doc_id, source, lang, n_chars and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.words import lower_ascii
from seriesloom.session import materialise

FAN = 16
SPAN = FAN * FAN  # nodes of a builder: two levels at a time

_NODE = "tree string, block long, total long, level int, index long, position long, digest string, doc_id long, claim string"
_PATH = "tree string, block long, before array<string>, after array<string>, subroot string, root string"
_PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"


@dataclass
class Manifest:
    """The logs of all source trees and of the tree over them, one table per turn of builders."""

    sources: list[DataFrame]
    above: list[DataFrame]

    def log(self) -> DataFrame:
        """tree (``-`` or ``=`` and the source, empty for the tree over the subroots), position, digest of all nodes."""
        own = [
            nodes.where(F.col("level") > 2 * turn) if turn else nodes
            for logs in (self.sources, self.above)
            for turn, nodes in enumerate(logs)
        ]
        whole = own[0]
        for nodes in own[1:]:
            whole = whole.union(nodes)
        return whole.select("tree", "position", "level", "index", "digest")


def height(total: int) -> int:
    """The level of the root of a tree over ``total`` leaves."""
    level = 0
    while FAN**level < total:
        level += 1
    return level


def position(total: int, level: int, index: np.ndarray) -> np.ndarray:
    """Places in the log of the nodes ``index`` of a level, counted from 0.

    Before a node stand the subtrees completed before its first leaf and what is below it: of its own and
    lower levels all nodes up to its last leaf, of higher ones those that end before its first leaf.
    """
    first = np.asarray(index, np.int64) * FAN**level
    last = np.minimum(first + FAN**level, total)
    place, depth = np.full(first.shape, -1, np.int64), 0
    while depth <= level or FAN**depth < total:
        width = FAN**depth
        place += -(-last // width) if depth <= level else first // width
        depth += 1
    return place


def digest_of(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(text: Column) -> Column:
    """SHA-256 over doc_id, source, lang, n_chars and ``text``, each as ``-`` or its byte count, ``:`` and value."""

    def part(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[part(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], part(text)), 256)


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``index``, their place in their ``tree`` by ``order``, and ``total``, the rows of the tree.

    Rows are sorted by range partitions, so a tree may stretch over many; the places follow from the
    row counts per tree and partition.
    """
    sorted_rows = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    placed = materialise(sorted_rows.withColumn("place", F.monotonically_increasing_id()), "placed")
    placed = placed.withColumn("piece", F.shiftright("place", 33))
    pieces = placed.groupBy("tree", "piece").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("tree").orderBy("piece"))
    pieces = pieces.select(
        "tree",
        "piece",
        (upto - F.col("n") - F.col("first")).alias("shift"),
        F.sum("n").over(Window.partitionBy("tree")).alias("total"),
    )
    placed = placed.join(pieces, ["tree", "piece"]).withColumn("index", F.col("place") + F.col("shift"))
    return placed.drop("place", "piece", "shift")


def _builder(turn: int):
    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("index")
        total, block = int(rows["total"].iloc[0]), int(key[1])
        nodes, first, written = list(rows["digest"]), block * SPAN, []
        for level in range(2 * turn, min(2 * turn + 2, height(total)) + 1):
            index = first + np.arange(len(nodes))
            written.append(pd.DataFrame({"level": level, "index": index, "position": position(total, level, index), "digest": nodes}))
            if level == 2 * turn:
                written[0] = written[0].assign(doc_id=rows["doc_id"].array, claim=rows["claim"].array)
            nodes = [digest_of(nodes[i : i + FAN]) for i in range(0, len(nodes), FAN)]
            first //= FAN
        done = pd.concat(written).sort_values("position", kind="stable")
        done["doc_id"] = done["doc_id"].astype("Int64")
        return done.assign(tree=key[0], block=block, total=total)[[c.split()[0] for c in _NODE.split(", ")]]

    return build


def build_log(leaves: DataFrame) -> list[DataFrame]:
    """The log of every tree, from tree, index, total, digest, doc_id, claim of its leaves; one table per turn.

    A turn's table starts from the nodes that its builders were given, which the turn before has completed.
    """
    logs: list[DataFrame] = []
    nodes = leaves
    while True:
        turn = len(logs)
        nodes = nodes.select(
            "tree", F.floor(F.col("index") / SPAN).cast("long").alias("block"), "total", "index", "digest", "doc_id", "claim"
        )
        logs.append(materialise(nodes.groupBy("tree", "block").applyInPandas(_builder(turn), _NODE), "nodes"))
        nodes = logs[-1].where((F.col("level") == 2 * turn + 2) & (F.col("total") > FAN ** (2 * turn + 2)))
        if nodes.isEmpty():
            return logs


def roots(logs: list[DataFrame]) -> DataFrame:
    """tree, turn (of the root's builder) and digest of the root."""
    found = None
    for turn, nodes in enumerate(logs):
        last = (F.col("total") <= F.pow(F.lit(float(FAN)), "level")) & (F.col("index") == 0)
        own = nodes.where(last & (F.col("level") > 2 * turn) if turn else last)
        own = own.groupBy("tree").agg(F.min_by("digest", "level").alias("digest")).withColumn("turn", F.lit(turn))
        found = own if found is None else found.union(own)
    return found


def _siblings(nodes: pd.DataFrame, turn: int, block: int) -> list[tuple[int, list[str], list[str]]]:
    """For each node given to a builder: its row, and level by level the digests before and after it in its run."""
    total = int(nodes["total"].iloc[0])
    places, digests = nodes["position"].to_numpy(), nodes["digest"].to_numpy()
    found, first = [], block * SPAN
    for i in range(min(SPAN, -(-total // FAN ** (2 * turn)) - first)):
        before, after = [], []
        for level in range(2 * turn, min(2 * turn + 2, height(total))):
            own = (first + i) // FAN ** (level - 2 * turn)
            run = np.arange(own // FAN * FAN, min(own // FAN * FAN + FAN, -(-total // FAN**level)))
            siblings = digests[np.searchsorted(places, position(total, level, run))]
            before.append("".join(siblings[: own % FAN]))
            after.append("".join(siblings[own % FAN + 1 :]))
        row = int(np.searchsorted(places, position(total, 2 * turn, np.array([first + i]))[0]))
        found.append((row, before, after))
    return found


def _pather(turn: int):
    def paths(key: tuple, nodes: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        nodes, up = nodes.sort_values("position"), path.iloc[0]
        out = [
            (key[0], key[1] * SPAN + i, [*before, *up["before"]], [*after, *up["after"]], up["subroot"], up["root"])
            for i, (_, before, after) in enumerate(_siblings(nodes, turn, int(key[1])))
        ]
        return pd.DataFrame(out, columns=["tree", "block", "before", "after", "subroot", "root"])

    return paths


def _prove(key: tuple, nodes: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
    nodes, up = nodes.sort_values("position"), path.iloc[0]
    ids, digests, claims = nodes["doc_id"].array, nodes["digest"].array, nodes["claim"].array
    above = [*zip(up["before"], up["after"], strict=True)]
    rest, out = "".join(b + a for b, a in above), []
    for row, before, after in _siblings(nodes, 0, int(key[1])):
        own = [*zip(before, after, strict=True)]
        folded = claims[row]
        for b, a in [*own, *above]:
            folded = digest_of((b, folded, a))
        out.append((ids[row], digests[row], up["subroot"], up["root"], digest_of([*(b + a for b, a in own), rest]), folded))
    out = pd.DataFrame(out, columns=[c.split()[0] for c in _PROOF.split(", ")])
    out["doc_id"] = out["doc_id"].astype("Int64")
    return out


def _paths(logs: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The paths above all blocks of the first turn, from those above the roots (``tops``, a path and turn per tree)."""
    names = ["tree", "block", "before", "after", "subroot", "root"]
    path = tops.where(F.col("turn") == len(logs) - 1).select(names)
    for turn in range(len(logs) - 1, 0, -1):
        groups = logs[turn].groupBy("tree", "block").cogroup(path.groupBy("tree", "block"))
        path = materialise(groups.applyInPandas(_pather(turn), _PATH), "paths")
        path = path.union(tops.where(F.col("turn") == turn - 1).select(names))
    return path


def build(docs: DataFrame, claimed: Column | None = None) -> Manifest:
    """The manifest of ``docs``; ``claimed`` is a text that ``prove`` checks in place of the document's own."""
    rows = docs.select("doc_id", "source", "lang", "n_chars", "text")
    claim = leaf_digest(F.col("text") if claimed is None else claimed)
    leaves = materialise(
        rows.select(
            F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")).alias("tree"),
            F.col("doc_id").cast("long").alias("doc_id"),
            leaf_digest(F.col("text")).alias("digest"),
            claim.alias("claim"),
            F.monotonically_increasing_id().alias("tie"),
        ),
        "leaves",
    )
    sources = build_log(ranked(leaves, "doc_id", "digest", "tie"))
    tops = roots(sources).select(
        F.col("tree").alias("name"), "digest", F.lit("").alias("tree"), F.lit(None).cast("long").alias("doc_id"), F.col("tree").alias("claim")
    )
    return Manifest(sources, build_log(ranked(tops, "name")))


def prove(manifest: Manifest) -> DataFrame:
    """For each leaf its proof's digest and the root that its claimed digest folds to along the proof.

    Returns doc_id, leaf, subroot, root, proof_sha256, folded_root, verified (the fold meets the root).
    """
    nothing = F.array().cast("array<string>")
    root = roots(manifest.above).select(
        "tree", "turn", F.lit(0).cast("long").alias("block"), nothing.alias("before"), nothing.alias("after"), F.lit("").alias("subroot"), F.col("digest").alias("root")
    )
    above = _paths(manifest.above, root)
    # the leaves of the upper tree are the subroots, their claims the names of the sources
    subroots = manifest.above[0].groupBy("tree", "block").cogroup(above.groupBy("tree", "block"))
    tops = materialise(subroots.applyInPandas(_subroot_paths, _PATH), "tops")
    tops = tops.join(roots(manifest.sources).select("tree", "turn"), "tree")
    path = _paths(manifest.sources, tops)
    groups = manifest.sources[0].groupBy("tree", "block").cogroup(path.groupBy("tree", "block"))
    proofs = groups.applyInPandas(_prove, _PROOF)
    return proofs.withColumn("verified", F.col("folded_root") == F.col("root"))


def _subroot_paths(key: tuple, nodes: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
    nodes, up = nodes.sort_values("position"), path.iloc[0]
    digests, names, out = nodes["digest"].array, nodes["claim"].array, []
    for row, before, after in _siblings(nodes, 0, int(key[1])):
        out.append((names[row], 0, [*before, *up["before"]], [*after, *up["after"]], digests[row], up["root"]))
    return pd.DataFrame(out, columns=["tree", "block", "before", "after", "subroot", "root"])


def tampered_text() -> Column:
    """``text`` with A-Z lower-cased where 5 divides the CRC-32 of the decimal doc_id, else as it is (null ids too)."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return F.when(chosen, lower_ascii(F.col("text"))).otherwise(F.col("text"))
