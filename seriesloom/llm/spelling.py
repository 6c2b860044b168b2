"""Spelling variants: words one edit apart, found by dense prefix-suffix tiles.

Words are maximal runs of letters with at least LEAST_LETTERS code points and LEAST_COUNT occurrences. Two are
near if one inserted, deleted or replaced code point turns one into the other, that is if common prefix plus
common suffix reach the longer length less one.

1. Counts: tasks count the runs of whole texts in a table of bounded size, Spark adds the counts up.
2. Blocks: the places of the edit in the longer word are cut into cells of GAP. Two words whose edit falls in
   a cell agree before it and after it, so a word enters, for each cell and each length that the longer word
   can have (its own and one more), a block keyed by that length, the cell, and what stands before and after.
   A block's words differ in at most GAP places, so it holds at most some alphabet^GAP words however large
   the corpus is.
3. Tiles: the words of a block are rows of two padded code-point matrices, one flushed left, one right. Rows
   are compared tile by tile (a stretch of rows with the same stretch shifted); the first column that differs
   gives the common prefix and suffix. A block of more than DENSE words is cut by single places first, which
   leaves at most the alphabet. A pair counts in the cell of its common prefix only, so it counts once.
4. A word's form is its most frequent near word (the smallest of equals) if that is RATIO times as frequent;
   roots follow the forms by pointer doubling, which ends after the logarithm of the longest chain.

Odd rows: null and empty texts hold no word; a null doc_id counts as an empty one where an occurrence is
altered. Repeated rows count again. An empty table gives an empty result; texts and words may have any
length; only doc_id and text are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.store import stored
from seriesloom.llm.words import chunks

LEAST_LETTERS, LEAST_COUNT = 7, 2
RATIO = 10  # a form is so many times as frequent
GAP = 3  # places of a cell
DENSE = 128  # words of a block that are compared pair by pair
TABLE = 200_000  # distinct words that a task holds before it passes their counts on
TILE = 1 << 22  # cells of a tile's matrices
_RUN = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LETTERS},}}")


def dropped_letter(doc_id: int | None, run: str, every: int = 31) -> str:
    """``run``, without a letter where ``every`` divides the CRC-32 of ``<doc_id>:<run>`` (h); the letter is h % length."""
    return _drop(zlib.crc32(run.encode(), zlib.crc32(b"%s:" % (b"" if doc_id is None else b"%d" % doc_id))), run, every)


def _drop(h: int, run: str, every: int) -> str:
    if h % every:
        return run
    i = h % len(run)
    return run[:i] + run[i + 1 :]


def _count_batches(every: int) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: Counter = Counter()

        def passed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(table), pa.string()), pa.array(list(table.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, _, data, bounds in chunks(batch.column(1)):
                whole = data.tobytes()
                for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    runs = Counter(_RUN.findall(whole[a:b].decode()))
                    if not every:
                        table.update(runs)
                        continue
                    doc_id = ids[first + i]
                    start = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
                    for run, n in runs.items():
                        h = zlib.crc32(run.encode(), start)
                        if h % every:
                            table[run] += n
                        elif len(run) > LEAST_LETTERS:
                            table[_drop(h, run, every)] += n
                if len(table) >= TABLE:
                    yield passed()
                    table.clear()
        if table:
            yield passed()

    return count


def vocabulary(docs: DataFrame, every: int = 0) -> DataFrame:
    """word, n: words of ``docs`` with enough letters and occurrences; with ``every``, occurrences are altered by ``dropped_letter``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = rows.mapInArrow(_count_batches(every), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= LEAST_COUNT)


def block_keys(word: Column) -> Column:
    """An array of structs (key, cell, longer) of all blocks of a word."""
    length = F.length(word)

    def cells(longer: Column, shift: int) -> Column:
        def block(c: Column) -> Column:
            low = c * GAP
            before = F.substring(word, F.lit(1), low)
            after = F.substring(word, low + (GAP + 1 - shift), length)
            key = F.xxhash64(longer, c, before, F.lit("\n"), after)
            return F.struct(key.alias("key"), c.alias("cell"), longer.alias("longer"))

        return F.transform(F.sequence(F.lit(0), F.floor((longer - 1) / GAP).cast("int")), block)

    return F.concat(cells(length, 0), cells(length + 1, 1))


def _matrices(words: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of ``words`` in rows flushed left and right (one byte each, as all are below 256; 0 pads), and lengths."""
    raw = np.frombuffer("".join(words.to_pylist()).encode("latin-1"), np.uint8)
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    places = np.arange(len(raw)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    left, right = np.zeros((2, len(lengths), width), np.uint8)
    left[rows, places] = raw
    right[rows, places + np.repeat(width - lengths, lengths)] = raw
    return left, right, lengths


def near_in_blocks(block: np.ndarray, cell: np.ndarray, longer: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows, from rows sorted by block, whose words are one edit apart in the block's cell."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    if not len(block):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    classes = np.ceil(np.log2(np.maximum(longer, 16))).astype(int)
    for size in np.unique(classes):  # words of like length share matrices
        chosen = np.flatnonzero(classes == size)
        width = 1 << int(size)
        left, right, lengths = _matrices(words.take(pa.array(chosen)), width)
        own, c, long = block[chosen], cell[chosen], longer[chosen]

        def compare(i: np.ndarray, j: np.ndarray) -> None:
            step = max(TILE // width, 1)
            for k in range(0, len(i), step):
                a, b = i[k : k + step], j[k : k + step]
                usable = (np.abs(lengths[a] - lengths[b]) <= 1) & ((lengths[a] == long[a]) | (lengths[b] == long[a]))
                a, b = a[usable], b[usable]
                shorter = np.minimum(lengths[a], lengths[b])
                unlike = left[a] != left[b]
                prefix = np.where(unlike.any(axis=1), unlike.argmax(axis=1), width)
                unlike = right[a][:, ::-1] != right[b][:, ::-1]
                suffix = np.where(unlike.any(axis=1), unlike.argmax(axis=1), width)
                prefix, suffix = np.minimum(prefix, shorter), np.minimum(suffix, shorter)
                same = (lengths[a] == lengths[b]) & (prefix == shorter)
                near = ~same & (prefix + suffix >= long[a] - 1) & (prefix // GAP == c[a])  # noqa: B023
                found.append((chosen[a[near]], chosen[b[near]]))  # noqa: B023

        starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        sizes = np.diff(np.append(starts, len(own)))
        row_size = np.repeat(sizes, sizes)
        rows = np.flatnonzero((row_size > 1) & (row_size <= DENSE))
        shift = 1
        while len(rows):  # a stretch of rows against the same stretch, shifted
            rows = rows[rows + shift < len(own)]
            rows = rows[own[rows] == own[rows + shift]]
            compare(rows, rows + shift)
            shift += 1
        for start, n in zip(starts[sizes > DENSE].tolist(), sizes[sizes > DENSE].tolist(), strict=True):
            _cut(np.arange(start, start + n), left, lengths, int(long[start]), int(c[start]), compare)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _cut(rows: np.ndarray, left: np.ndarray, lengths: np.ndarray, longer: int, cell: int, compare: Callable) -> None:
    """Compare the words of a large block by the single places of its cell: those that agree in all others."""
    seen: set[tuple[int, int]] = set()
    for place in range(cell * GAP, min(cell * GAP + GAP, longer)):
        groups: dict[bytes, list[int]] = {}
        for row in rows.tolist():
            n, word = int(lengths[row]), left[row, : lengths[row]].tobytes()
            groups.setdefault(word[:place] + b"\0" + word[place + (n == longer) :], []).append(row)
        for members in groups.values():
            pairs = [(x, y) for i, x in enumerate(members) for y in members[i + 1 :] if (x, y) not in seen]
            seen.update(pairs)
            if pairs:
                both = np.array(pairs)
                compare(both[:, 0], both[:, 1])


_NEAR = "word string, n_near long, best_n long, best string"


def _near_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, cell, longer, word, n) sorted by key to partial sums of near words."""

    def near(held: pa.Table) -> pa.RecordBatch:
        key, cell, longer, n = (held.column(c).to_numpy() for c in ("key", "cell", "longer", "n"))
        alone = np.ones(len(key), bool)
        alone[1:] &= key[1:] != key[:-1]
        alone[:-1] &= key[1:] != key[:-1]
        rows = np.flatnonzero(~alone)
        words = held.column("word").combine_chunks().take(pa.array(rows))
        # blocks whose keys collide differ in cell or length
        block = np.cumsum(np.append(False, (key[rows][1:] != key[rows][:-1]) | (cell[rows][1:] != cell[rows][:-1]) | (longer[rows][1:] != longer[rows][:-1])))
        i, j = near_in_blocks(block, cell[rows], longer[rows], words)
        a, b = np.append(i, j), np.append(j, i)
        return pa.RecordBatch.from_arrays(
            [words.take(pa.array(a)), pa.array(np.ones(len(a), np.int64)), pa.array(n[rows][b]), words.take(pa.array(b))],
            names=[c.split()[0] for c in _NEAR.split(", ")],
        )

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < 1 << 16:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = table.column("key")[-1].as_py()
        whole = int(np.searchsorted(table.column("key").to_numpy(), last))  # the last block may go on
        if whole:
            yield near(table.slice(0, whole))
        held = table.slice(whole).to_batches()
        size = table.num_rows - whole
    if held:
        yield near(pa.Table.from_batches(held).combine_chunks())


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best (its most frequent near word, the smallest of equals), best_n, for words that have a near one."""
    rows = words.select(F.explode(block_keys(F.col("word"))).alias("b"), "word", "n").select("b.key", "b.cell", "b.longer", "word", "n")
    blocks = rows.repartition("key").sortWithinPartitions("key", "cell", "longer")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    found = blocks.mapInArrow(_near_batches, _NEAR).groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return found.select("word", "n_near", F.col("best.word").alias("best"), (-F.col("best.n")).alias("best_n"))


def spelling_forms(docs: DataFrame, every: int = 0) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of ``docs`` (see ``vocabulary``); form and form_n are null without a form."""
    words = stored(vocabulary(docs, every), "words")
    has_form = F.col("best_n") >= RATIO * F.col("n")
    formed = words.join(near_words(words), "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(has_form, F.col("best")).alias("form"),
        F.when(has_form, F.col("best_n")).alias("form_n"),
    )
    formed = stored(formed, "forms")
    roots = formed.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(roots.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
