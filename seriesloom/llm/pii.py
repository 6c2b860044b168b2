"""Personal data by bootstrapped contextual extraction.

Forms (e-mail addresses, IP addresses, card and telephone numbers) give the seed entities. A pattern is
the one or two words before a candidate, or the word behind it. A candidate is a word with the characters
of an identifier (digits, or an @), the value of such a word of the form label=value or label:value, what
seeds leave of a word, and a run of such words, or of groups of digits alone, joined by blanks or by lone
separators. All of these are candidates side by side, as 12345 67890 may be one number or two; of accepted
ones that overlap, the one of greatest confidence stays, then the longest. Pattern and candidate instances form a
bipartite graph over the whole corpus, which Spark scores in rounds:

    confidence of a pattern for a kind = sum of its instances' confidences / (distinct instances + 1)
    confidence of an instance          = 1 - product over its good patterns of (1 - confidence)

Seeds have confidence 1 for their kind and 0 for others. Patterns count only with a support of MIN_SEEDS,
the sum of their distinct instances' confidences, and a confidence of GOOD_PATTERN or more; candidates with
MIN_PATTERNS of them that reach ACCEPT are accepted, add spans and support patterns like seeds from the next
round on. Rounds go on until none accepts a new instance. Distinct instances per pattern are counted before
the shuffle, so a frequent word before many numbers is one hot key with small partial sums.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.session import materialise

KINDS = ("email", "ip", "card", "phone")
MIN_SEEDS = 5  # seeds, or accepted instances by their confidence, that a pattern needs
GOOD_PATTERN = 0.8
ACCEPT = 0.85
MIN_PATTERNS = 2  # good patterns an instance needs: one word beside it is no evidence

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# no match can begin inside a run of digits where none began at its start, so only starts are tried
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CANDIDATE = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*")
_LABEL = re.compile(r"[^\x20\x09-\x0D0-9@=:]+[=:]+")
_MARK = re.compile("[0-9@]")
_JOINT = re.compile(r"[\x20\x09]+(?:[./-][\x20\x09]+)?")
_GROUP = re.compile(r"[+(]*[0-9][0-9()./+-]*")
_OPEN_END = re.compile(r"[A-Za-z0-9)]")
_OPEN_START = re.compile(r"[A-Za-z0-9(+]")
_TRIM = "\"'()[]{}<>,;:.!?=#*$&|%"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of all seeds: leftmost, non-overlapping per kind, failing matches dropped."""
    out = [(0, a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


_BLANK = " \t\n\v\f\r"


def _tidy(word: str) -> str:
    """The word as it stands in patterns; a long one as its hash (no tidy word begins with #)."""
    word = word.strip(_TRIM).lower()
    return word if len(word) <= 64 else "#" + blake2b(word.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


class _Context:
    """The words beside places of one text. A seed glued to a word bounds it."""

    def __init__(self, text: str, taken: list[list[int]]) -> None:
        self.text = text
        self.starts, self.ends = [a for a, _ in taken], [b for _, b in taken]
        self.before: dict[int, tuple[int, str]] = {}
        self.after: dict[int, str] = {}

    def _word_before(self, at: int) -> tuple[int, str] | None:
        """Start and tidy form of the word that ends before ``at``."""
        text = self.text
        end = at
        while end > 0 and text[end - 1] in _BLANK:
            end -= 1
        if end == 0:
            return None
        if end not in self.before:
            k = bisect_left(self.ends, end)  # the last seed that ends before ``end``
            floor = self.ends[k - 1] if k else 0
            begin = end
            while begin > floor and text[begin - 1] not in _BLANK:
                begin -= 1
            self.before[end] = begin, _tidy(text[begin:end])
        return self.before[end]

    def patterns(self, start: int, end: int) -> list[str]:
        near = self._word_before(start)
        far = self._word_before(near[0]) if near else None
        out = [f"L1 {near[1]}"] if near and near[1] else []
        if far and far[1]:
            out.append(f"L2 {far[1]} {near[1]}")
        if after := self._word_after(end):
            out.append(f"R1 {after}")
        return out

    def _word_after(self, at: int) -> str:
        text = self.text
        while at < len(text) and text[at] in _BLANK:
            at += 1
        if at == len(text):
            return ""
        if at not in self.after:
            word = _WORD.match(text, at)
            k = bisect_left(self.starts, at + 1)  # the first seed that begins behind ``at``
            end = min(word.end(), self.starts[k]) if k < len(self.starts) else word.end()
            self.after[at] = _tidy(text[at:end])
        return self.after[at]


def _pieces(text: str, merged: list[list[int]]) -> Iterator[tuple[int, int]]:
    """Words with a digit or @, without the seeds in them."""
    i = 0
    for m in _CANDIDATE.finditer(text):
        start, end = m.span()
        while i < len(merged) and merged[i][1] <= start:
            i += 1
        while i < len(merged) and merged[i][0] < end:
            if merged[i][0] > start:
                yield start, merged[i][0]
            start = merged[i][1]
            if start >= end:
                break
            i += 1
        if start < end:
            yield start, end


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    word = text[start:end]
    left = len(word) - len(word.lstrip(_TRIM))
    return start + left, max(start + left, end - (len(word) - len(word.rstrip(_TRIM))))


def _has_mark(text: str, start: int, end: int) -> bool:
    return _MARK.search(text, start, end) is not None


def candidate_spans(text: str, merged: list[list[int]]) -> list[tuple[int, int]]:
    """Places of all candidates outside the seeds."""
    spans: dict[tuple[int, int], None] = {}
    runs: list[list[int] | None] = [None, None]  # of words with a mark, of groups of digits: start, end, words

    def close(which: int) -> None:
        run = runs[which]
        if run and run[2] > 1:
            spans[_trimmed(text, run[0], run[1])] = None
        runs[which] = None

    for start, end in _pieces(text, merged):
        if not _has_mark(text, start, end):
            continue
        spans[_trimmed(text, start, end)] = None
        label = _LABEL.match(text, start, end)
        value = label.end() if label else start
        if label and _has_mark(text, value, end):
            spans[_trimmed(text, value, end)] = None
        # a label begins a run; a word with punctuation on its outside ends one
        group = _GROUP.match(text, value, end)
        of_digits = group is not None and text[group.end() : end].strip(_TRIM) == ""
        for which, fits in ((0, True), (1, of_digits)):
            run = runs[which]
            joined = run and value == start and (gap := _JOINT.match(text, run[1])) and gap.end() == start
            joined = joined and _OPEN_END.match(text, run[1] - 1) and _OPEN_START.match(text, start)
            if not (fits and joined):
                close(which)
            if fits:
                run = runs[which]
                runs[which] = [run[0], end, run[2] + 1] if run else [value if value < end else start, end, 1]
    close(0)
    close(1)
    return [x for x in spans if x[1] - x[0] >= 4]


def events_of(text: str, seeds: list[tuple[int, int, int]]) -> list[dict]:
    """Seeds (with kind) and candidates (kind -1) of a text with the patterns they occur in."""
    taken = sorted((a, b) for _, a, b in seeds)
    merged: list[list[int]] = []
    for a, b in taken:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    places = [*seeds, *((-1, a, b) for a, b in candidate_spans(text, merged))]
    context = _Context(text, merged)
    return [{"kind": k, "start": a, "end": b, "instance": text[a:b].lower(), "patterns": context.patterns(a, b)} for k, a, b in places]


_EVENTS = pa.list_(
    pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])
)
FOUND = "row_id long, doc_id long, events array<struct<kind:int,start:bigint,end:bigint,instance:string,patterns:array<string>>>"


def _find_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        events = []
        for value in batch.column(1):
            text = value.as_py() or ""
            events.append(events_of(text, base_spans(text)))
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(row, row + n), pa.int64()), batch.column(0), pa.array(events, _EVENTS)], names=["row_id", "doc_id", "events"]
        )
        row += n


def find(docs: DataFrame) -> DataFrame:
    """Seeds and candidates of every document: row_id (a row's number), doc_id, events."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_find_batches, FOUND)


def _hopeful(edges: DataFrame) -> DataFrame:
    """The edges, with their pattern's size, of patterns that could become good if every open candidate were accepted.

    A candidate is open that has MIN_PATTERNS patterns of MIN_SEEDS instances. The bounds hold in every round,
    so nothing is lost with the rest.
    """
    sized = edges.join(edges.groupBy("pattern").agg(F.count("*").alias("n")).where(f"n >= {MIN_SEEDS}"), "pattern")
    sized = materialise(sized, "sized")
    open_ = sized.where("seed < 0").groupBy("instance").count().where(f"count >= {MIN_PATTERNS}").select("instance", F.lit(True).alias("open"))
    sized = sized.join(open_, "instance", "left").where("seed >= 0 or open")
    at_most = [F.count(F.when((F.col("seed") == k) | (F.col("seed") < 0), 1)) for k in range(len(KINDS))]
    most = sized.groupBy("pattern", "n").agg(F.greatest(*at_most).alias("most"))
    able = most.where(f"most >= {MIN_SEEDS} and most >= {GOOD_PATTERN} * (n + 1)").select("pattern")
    return materialise(sized.join(able, "pattern").select("pattern", "instance", "seed", "n"), "edges")


def discover(events: DataFrame, rounds: int | None = None) -> DataFrame:
    """Unseen identifiers from (kind, instance, patterns) rows: instance, kind, confidence.

    Only instances that are no seed of any kind are returned, each with the kind that was best when it was
    accepted. Ends after ``rounds``, or without them when a round accepts nothing new.
    """
    spark = events.sparkSession
    pairs = events.select(F.explode(F.array_distinct("patterns")).alias("pattern"), "instance", "kind")
    edges = _hopeful(materialise(pairs.groupBy("pattern", "instance").agg(F.max("kind").alias("seed")), "pairs"))
    accepted = spark.createDataFrame([], "instance string, kind int, confidence double")
    n_accepted = done = 0
    while rounds is None or done < rounds:
        known = accepted.select("instance", F.col("kind").alias("got"), "confidence")
        rated = edges.join(known, "instance", "left").select(
            "pattern",
            "n",
            F.when(F.col("seed") >= 0, F.col("seed")).otherwise(F.col("got")).alias("kind"),
            F.when(F.col("seed") >= 0, F.lit(1.0)).otherwise(F.col("confidence")).alias("weight"),
        )
        per_kind = rated.where("kind is not null").groupBy("pattern", "kind", "n").agg(F.sum("weight").alias("sum"))
        good = (
            per_kind.where(f"sum >= {MIN_SEEDS}")
            .select("pattern", "kind", (F.col("sum") / (F.col("n") + 1)).alias("p"))
            .where(f"p >= {GOOD_PATTERN}")
        )
        proposals = edges.where("seed < 0").join(good, "pattern")
        scored = proposals.groupBy("instance", "kind").agg(
            (1 - F.exp(F.sum(F.log(1 - F.col("p"))))).alias("confidence"), F.count("*").alias("patterns")
        ).where(f"patterns >= {MIN_PATTERNS} and confidence >= {ACCEPT}")
        best = scored.groupBy("instance").agg(F.max(F.struct("confidence", "kind")).alias("b"))
        best = best.select("instance", F.col("b.kind").alias("kind"), F.col("b.confidence").alias("confidence"))
        # an accepted instance stays with its kind, so the rounds end
        grown = best.join(known.withColumnRenamed("confidence", "before"), "instance", "full").select(
            "instance",
            F.coalesce("got", "kind").alias("kind"),
            F.when(F.col("got").isNull() | (F.col("got") == F.col("kind")), F.greatest("confidence", "before"))
            .otherwise(F.col("before"))
            .alias("confidence"),
        )
        accepted = materialise(grown, "accepted")
        done += 1
        if (n := accepted.count()) == n_accepted:
            break
        n_accepted = n
    return accepted


_SPANS = "array<struct<kind:int,start:bigint,end:bigint>>"
_ADDED = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))


def without_overlaps(found: list[dict]) -> list[dict]:
    """Of spans that overlap the one of greatest confidence, then the longest, then the first."""
    starts: list[int] = []
    kept: list[dict] = []
    for x in sorted(found, key=lambda x: (-x["confidence"], x["start"] - x["end"], x["start"])):
        k = bisect_left(starts, x["start"])
        if (k == 0 or kept[k - 1]["end"] <= x["start"]) and (k == len(kept) or x["end"] <= starts[k]):
            starts.insert(k, x["start"])
            kept.insert(k, x)
    return kept


def _settle_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        added = [[{k: x[k] for k in ("kind", "start", "end")} for x in without_overlaps(row)] for row in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(added, _ADDED)], names=["row_id", "added"])


def extract(docs: DataFrame, rounds: int | None = None) -> DataFrame:
    """doc_id, base and spans of every row of ``docs`` (doc_id, text).

    ``base`` has the seeds, ``spans`` these and the discovered ones, both arrays of (kind number, start,
    end) sorted by kind and start; offsets are code points, end exclusive. A discovered span never
    overlaps a seed or another discovered one. A null or empty text has no spans; repeated rows have theirs each and count once as
    an instance; a null doc_id passes through; other columns are ignored; an empty table gives an empty
    result.
    """
    found = materialise(find(docs), "events")
    rows = found.select("row_id", F.explode("events").alias("e")).select("row_id", "e.*")
    new = discover(rows.select("kind", "instance", "patterns"), rounds)
    added = (
        rows.where("kind < 0")
        .select("row_id", "start", "end", "instance")
        .join(new, "instance")
        .groupBy("row_id")
        .agg(F.collect_list(F.struct("kind", "start", "end", "confidence")).alias("found"))
        .mapInArrow(_settle_batches, f"row_id long, added {_SPANS}")
    )
    seeds = F.transform(F.filter("events", lambda e: e["kind"] >= 0), lambda e: F.struct(e["kind"].alias("kind"), e["start"].alias("start"), e["end"].alias("end")))
    none = F.array().cast(_SPANS)
    return (
        found.select("row_id", "doc_id", F.array_sort(seeds).alias("base"))
        .join(added, "row_id", "left")
        .select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("added", none))).alias("spans"))
    )
