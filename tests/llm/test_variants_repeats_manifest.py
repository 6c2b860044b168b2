"""Spelling variants, removal of repeats and the manifest against brute force on small tables with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter
from unittest.mock import patch

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import manifest, repeats, spelling

DOCS = "doc_id long, text string, lang string, source string, n_chars long, word string, tree string, row string, anchor long, k1 long"


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, multi-byte characters, columns with the names of results."""
    r = random.Random(7)
    letters = "abcdeé"
    passage = " ".join("".join(r.choices(letters, k=r.randint(2, 11))) for _ in range(120))
    rows = []
    for i in range(40):
        own = " ".join("".join(r.choices(letters, k=r.randint(2, 11))) for _ in range(r.randint(0, 150)))
        if i % 4 == 1:
            cut = r.randint(0, 300)
            own = own[:200] + passage[cut : cut + 420 + 30 * (i % 3)] + own[200:]
        if i % 8 == 2:
            own += passage + own
        if i % 5 == 0:
            own += " Variants variants varianta variants variantt VARIANTS variants variants variants variants variants variants variants"
        rows.append((i, own, "en", f"s{i % 3}"))
    rows += [(100, None, None, None), (101, "", "en", None), (102, "x" * 399, "de", "s1"), (None, passage, "en", "s1"), (None, None, None, "")]
    rows += [(7, rows[7][1], "en", "s1")] * 2 + [(103, "long words " * 9000, "en", "ß"), (104, "ab" * 700, "en", "z"), (105, "é" * 250 + "a" + "é" * 250, "en", "z")]
    return spark.createDataFrame([(*x, len(x[1] or "") if x[1] else None, "w", "t", "r", 1, 2) for x in rows], DOCS)


def empty(df):
    return df.limit(0)


# ---------------------------------------------------------------- spelling


def altered(doc_id, run):
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    return run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute_forms(counts):
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def test_forms_of_documents(docs):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = Counter()
    for row in docs.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", row.text or ""):
            counts[altered(row.doc_id, run.translate(lower))] += 1
    got = {tuple(r) for r in spelling.spelling_forms(docs, every=31).collect()}
    assert got == brute_forms(counts) and any(f for _, f, *_ in got)
    assert spelling.spelling_forms(empty(docs), every=31).count() == 0


def test_forms_of_dense_words(spark):
    """Few letters and like lengths: many near words, runs of one letter, chains of forms, a block cut by places."""
    r = random.Random(3)
    words = {"".join(r.choices("ab", k=r.randint(7, 9))) for _ in range(300)} | {"a" * k for k in (7, 8, 9, 40, 300)}
    words |= {"stemwor" + a + b + c for a in "abcdef" for b in "abcdefg" for c in "abcdefgh"}
    counts = {w: r.choice([2, 3, 20, 30, 300, 4000]) for w in sorted(words)}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    with patch.object(spelling, "vocabulary", lambda docs, every: table):
        got = {tuple(x) for x in spelling.spelling_forms(None).collect()}
    assert got == brute_forms(counts)
    assert any(root != form for _, form, root, *_ in got if form)  # a chain of two at least


def test_blocks_hold_a_pair_once_and_no_word_of_another_length():
    words = ["abcdefgh", "abcdefg", "abcdefgx", "abcdxfgh", "abcdefghi"]
    keys = {}
    for w in words:
        for longer in (len(w), len(w) + 1):
            for c in range(-(-longer // spelling.GAP)):
                low, shift = c * spelling.GAP, longer - len(w)
                keys.setdefault((longer, c, w[:low], w[low + spelling.GAP - shift :] if low + spelling.GAP - shift < len(w) else ""), []).append(w)
    rows = [(i, c, longer, w) for i, ((longer, c, _, _), ws) in enumerate(sorted(keys.items())) for w in ws]
    block, cell, longer = (np.array([x[k] for x in rows]) for k in range(3))
    i, j = spelling.near_in_blocks(block, cell, longer, pa.array([x[3] for x in rows]))
    pairs = Counter(tuple(sorted((rows[a][3], rows[b][3]))) for a, b in zip(i, j))
    assert pairs == Counter({tuple(sorted((a, b))): 1 for x, a in enumerate(words) for b in words[:x] if one_edit(a, b)})


# ---------------------------------------------------------------- repeats


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        last = -1
        for i in range(len(d) - length + 1):
            if counts[d[i : i + length]] > 1:
                for k in range(max(i, last), i + length):
                    gone[k] = True
                last = i + length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def stripped(df):
    rows = repeats.strip_repeats(df).collect()
    return [(r.row, sum(s.high - s.low for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows]


@pytest.mark.parametrize("group", [200, 1])
def test_repeats(docs, group):
    """With ``group`` 1 all that shares an anchor takes the way of very common passages, down to single windows."""
    with patch.object(repeats, "GROUP", group):
        got = stripped(docs)
    rows = docs.collect()
    want = brute_repeats([r.text for r in rows], repeats.LENGTH)
    key = str
    assert sorted(((r.doc_id, len((r.text or "").encode()), n, s, h) for r, n, s, h in got), key=key) == sorted(
        ((r.doc_id, *w) for r, w in zip(rows, want)), key=key
    )
    assert any(s > 1 for _, _, s, _ in got)
    assert repeats.strip_repeats(empty(docs)).count() == 0


def test_repeats_where_joins_split_a_skewed_anchor(spark):
    """A cell's different segments meet in one task, however the join before deals them out."""
    r = random.Random(4)
    passage = "".join(r.choices("abcdefgh", k=900))
    cuts = [sorted(r.sample(range(900), 2)) for _ in range(60)]
    rows = [(i, "".join(r.choices("xyz", k=300)) + passage[a : max(b, a + 420)] + "".join(r.choices("xyz", k=300))) for i, (a, b) in enumerate(cuts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    split = {
        "autoBroadcastJoinThreshold": "-1",
        "files.maxPartitionBytes": "4k",
        "files.openCostInBytes": "4k",
        "adaptive.coalescePartitions.enabled": "false",
        "adaptive.advisoryPartitionSizeInBytes": "1",
        "adaptive.forceOptimizeSkewedJoin": "true",
        "adaptive.skewJoin.skewedPartitionFactor": "0.1",
        "adaptive.skewJoin.skewedPartitionThresholdInBytes": "1",
    }
    before = {k: spark.conf.get(f"spark.sql.{k}", None) for k in split}
    try:
        for k, v in split.items():
            spark.conf.set(f"spark.sql.{k}", v)
        with patch.object(repeats, "GROUP", 8):
            got = stripped(docs)
    finally:
        for k, v in before.items():
            spark.conf.unset(f"spark.sql.{k}") if v is None else spark.conf.set(f"spark.sql.{k}", v)
    want = brute_repeats([x.text for x in docs.collect()], repeats.LENGTH)
    assert sorted((r.doc_id, n, s, h) for r, n, s, h in got) == [(i, *w[1:]) for i, w in enumerate(want)]


def test_repeats_of_long_texts_in_pieces(spark):
    r = random.Random(1)
    text = "".join(r.choices("abcdefgh", k=9000))
    docs = spark.createDataFrame([(1, text + text[1000:3000]), (2, "y" + text[4000:4500] + "z" * 1500)], "doc_id long, text string")
    with patch.object(repeats, "PIECE", 1 << 10):
        got = stripped(docs)
    want = brute_repeats([x.text for x in docs.collect()], repeats.LENGTH)
    assert sorted((n, s, h) for _, n, s, h in got) == sorted(w[1:] for w in want)


def test_run_index_matches():
    r = random.Random(2)
    base = bytes(r.choices(b"ab", k=300))
    strings = [base[:200], base[100:], b"a" * 50, b"ab" * 30, base[50:250] + b"c" + base[:40]]
    index = repeats.RunIndex(strings)
    got = index.longest()
    whole = b"".join(strings)
    for k, s in enumerate(strings):
        for i in range(0, len(s), 7):
            best = 0
            for other, t in enumerate(strings):
                for j in range(len(t)):
                    if (k, i) != (other, j):
                        n = 0
                        while i + n < len(s) and j + n < len(t) and s[i + n] == t[j + n]:
                            n += 1
                        best = max(best, n)
            assert got[index.starts[k] + i] == best
    assert index.n_runs < len(whole)


# ---------------------------------------------------------------- manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(tree, i):
    for level in tree[:-1]:
        first = i // 16 * 16
        yield level[first:i], level[i + 1 : first + 16]
        i //= 16


def brute_manifest(rows):
    def part(value):
        return "-" if value is None else f"{len(str(value).encode())}:{value}"

    def leaf(r, text):
        return sha(part(r.doc_id), part(r.source), part(r.lang), part(r.n_chars), part(text))

    def lower(text):
        return None if text is None else re.sub("[A-Z]", lambda m: m[0].lower(), text)

    sources = {}
    for r in rows:
        changed = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
        sources.setdefault(r.source, []).append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), leaf(r, lower(r.text) if changed else r.text), r.doc_id))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(sources[s])]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (_, _, own, claim, doc_id) in enumerate(sorted(sources[s])):
            path = [*siblings(trees[s], i), *siblings(top, k)]
            folded = claim
            for before, after in path:
                folded = sha(*before, folded, *after)
            proof = sha(*(x for before, after in path for x in (*before, *after)))
            out.append((doc_id, own, trees[s][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(out, key=str)


def test_manifest(docs, spark):
    # a source of 600 leaves needs a second turn of builders, 300 sources a second turn above
    more = spark.range(1000, 1600).select(F.col("id").alias("doc_id"), F.concat(F.lit("Text "), F.col("id").cast("string")).alias("text"), F.lit("big").alias("source"))
    many = spark.range(2000, 2300).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.concat(F.lit("m"), F.col("id").cast("string")).alias("source"))
    table = docs.unionByName(more, allowMissingColumns=True).unionByName(many, allowMissingColumns=True)
    built = manifest.build(table, manifest.tampered_text())
    got = sorted((tuple(r) for r in manifest.prove(built).collect()), key=str)
    want = brute_manifest(table.collect())
    assert got == want and {r[-1] for r in got} == {True, False}
    # every log is whole, and its children stand before their parent
    nodes = built.log().collect()
    for tree in {n.tree for n in nodes}:
        own = sorted((n for n in nodes if n.tree == tree), key=lambda n: n.position)
        assert [n.position for n in own] == list(range(len(own)))
        last = {}
        for n in own:
            if n.level:
                assert all(last[n.level - 1, 16 * n["index"] + k] < n.position for k in range(16) if (n.level - 1, 16 * n["index"] + k) in last)
            last[n.level, n["index"]] = n.position
        assert own[-1].level == max(n.level for n in own)


def test_manifest_of_little(docs, spark):
    assert manifest.prove(manifest.build(empty(docs))).count() == 0
    one = docs.where("doc_id = 100")
    row = manifest.prove(manifest.build(one)).first()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.proof_sha256 == sha() and row.verified


@pytest.mark.parametrize("total", [1, 2, 16, 17, 255, 256, 257, 4096, 5000])
def test_positions_are_those_of_a_walk(total):
    order = []

    def walk(level, index):
        if level:
            for child in range(16 * index, min(16 * index + 16, -(-total // 16 ** (level - 1)))):
                walk(level - 1, child)
        order.append((level, index))

    walk(manifest.height(total), 0)
    places = {node: i for i, node in enumerate(order)}
    for level in range(manifest.height(total) + 1):
        index = np.arange(-(-total // 16**level))
        assert manifest.position(total, level, index).tolist() == [places[level, int(i)] for i in index]
