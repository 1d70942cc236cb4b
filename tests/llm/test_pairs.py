"""Jaccard classes, line dedup and what they share."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from common import corpus, docs, words
from framelake.llm import graph, jaccard, lines


def sets_of(text, n):
    w = "".join(c.lower() if c.isascii() else c for c in (text or "")).split()
    if not w:
        return set()
    return {tuple(w)} if len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def classes(rows, n, num, den):
    sets = [sets_of(t, n) for _, t in rows]
    cls = {i: i for i, _ in rows}

    def root(i):
        while cls[i] != i:
            i = cls[i]
        return i

    for p, (i, _) in enumerate(rows):
        for q in range(p):
            j = rows[q][0]
            common = len(sets[p] & sets[q])
            if sets[p] and sets[q] and den * common >= num * len(sets[p] | sets[q]):
                a, b = root(i), root(j)
                cls[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for (i, _), s in zip(rows, sets, strict=True)}


@pytest.mark.parametrize(("n", "num", "leaf_rows"), [(3, 90, 1500), (2, 70, 4)])
def test_jaccard_is_exact(spark, n, num, leaf_rows):
    rows = corpus(n)
    got = jaccard.jaccard_classes(docs(spark, rows), n, num, 100, leaf_rows=leaf_rows).collect()
    assert len(got) == len(rows)
    want = classes([r for r in rows if r[0] is not None], n, num, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_one_document_of_each_class_stays(spark):
    rows = corpus(9, 30)
    kept = [r.doc_id for r in jaccard.keep_one(docs(spark, rows), 3, 90, 100).collect()]
    want = classes([r for r in rows if r[0] is not None], 3, 90, 100)
    assert sorted(k for k in kept if k is not None) == sorted({c for _, c in want.values()}) and kept.count(None) == 1


def test_passages_that_all_share_make_no_large_region(spark, monkeypatch):
    """Pairs of near copies around one passage are parted by their rare n-grams; before, all were one region for the Voronoi cells."""
    monkeypatch.setattr(jaccard, "_voronoi", lambda *_: pytest.fail("a large region is left"))
    rng = random.Random(3)
    passage, rows = words(rng, 40, 10_000), []
    for i in range(60):
        own = words(rng, 60, 10_000)
        rows += [(2 * i, f"{own} {passage}"), (2 * i + 1, f"{own} x{i} {passage}" if i % 3 else f"{words(rng, 60, 10_000)} {passage}")]
    got = jaccard.jaccard_classes(docs(spark, rows), 5, 80, 100, leaf_rows=20).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == classes(rows, 5, 80, 100)


def test_large_regions_keep_the_links_of_both_texts_of_a_doc_id(spark):
    rng = random.Random(4)
    passage = words(rng, 40, 10_000)
    own = [words(rng, 60, 10_000) for _ in range(30)]
    rows = [(i, f"{x} {passage}") for i, x in enumerate(own)] + [(30, f"{own[7]} x {passage}"), (30, f"{passage} {words(rng, 300, 10_000)}")]
    got = jaccard.jaccard_classes(docs(spark, rows), 5, 80, 100, leaf_rows=10).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: 7 if i == 30 else i for i in range(31)}


def test_a_cut_leaves_no_shuffle_files(spark):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {x for x in found.split("\n") if "shuffle_" in x}

    before = files()
    got = graph.cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before
    assert got.agg(F.sum("count")).first()[0] == 1000 and spark.conf.get(graph.FREE, None) in (None, "false")


def test_empty_tables(spark):
    none = docs(spark, [])
    assert jaccard.jaccard_classes(none).count() == 0 and jaccard.keep_one(none).count() == 0
    assert lines.line_digest(none).count() == 0 and lines.dedup_lines(none).count() == 0


def test_parts_miss_no_link():
    rng = np.random.default_rng(5)

    def hashes(n):
        return np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))

    for _ in range(400):
        a = hashes(int(rng.integers(2, 90)))
        b = np.unique(np.concatenate([rng.permutation(a)[int(rng.integers(0, 1 + len(a) // 9)) :], hashes(int(rng.integers(0, 3)))]))
        common = len(np.intersect1d(a, b))
        if 100 * common >= 90 * (len(a) + len(b) - common) and common < max(len(a), len(b)):
            assert len(np.intersect1d(jaccard.part_keys(a, 90, 100), jaccard.part_keys(b, 90, 100)))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 100)]
    got = dict(graph.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 100}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, s, k):
    for _ in range(k):
        i = rng.randrange(len(s) + 1)
        s = rng.choice((s[:i] + rng.choice("aé") + s[i:], s[:i] + s[i + 1 :], s[:i] + "z" + s[i + 1 :]))
    return s


def line_corpus(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeé ") for _ in range(rng.choice((20, 21, 39, 40, 41, 60)))) for _ in range(8)]
    rows = [(i, "\n".join(edited(rng, rng.choice(base), rng.choice((0, 0, 1, 2, 3))) for _ in range(rng.randrange(1, 6)))) for i in range(25)]
    return [*rows, (30, None), (31, ""), (32, "short\nshort"), rows[2], (None, rows[0][1])]


@pytest.mark.parametrize("edits", [1, 2])
def test_line_dedup_is_exact(spark, edits):
    rows = line_corpus(edits)
    seen = {}
    for i, t in rows:
        if i is not None and t is not None:
            for p, line in enumerate(t.split("\n")):
                seen[i, p] = line
    places = sorted(seen)
    different = sorted({s for s in seen.values() if len(s) >= 20})
    cls = {s: s for s in different}

    def root(s):
        while cls[s] != s:
            s = cls[s]
        return s

    for p, a in enumerate(different):
        for b in different[:p]:
            if distance(a, b) <= min(edits, min(len(a), len(b)) // 20):
                cls[root(a)] = root(b)
    first, lead, want = {}, {}, {}
    for at in places:
        s = seen[at]
        if len(s) < 20:
            want[at] = (True, False)
            continue
        first.setdefault(s, at)
        lead.setdefault(root(s), at)
        want[at] = (lead[root(s)] == at, first[s] != at)
    got = lines.kept_lines(docs(spark, rows), edits, whole=False).select("doc_id", "pos", "kept", "exact").distinct().collect()
    assert {(r[0], r[1]): (r[2], r[3]) for r in got} == want
    clean = {r.doc_id: r.text for r in lines.dedup_lines(docs(spark, rows), edits, whole=False).where("doc_id is not null").collect()}
    for i, t in rows:
        if i is not None:
            assert clean[i] == (None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if want[i, p][0]))


def test_banded_distance(spark):
    rng = random.Random(3)
    pairs = []
    for _ in range(300):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(22, 90)))
        pairs.append((a, edited(rng, a, rng.randrange(5))))
    df = spark.createDataFrame(pairs, "a string, b string")
    for edits in (1, 2, 3):
        got = df.select("a", "b", lines.within_edits(df.a, df.b, edits).alias("near")).collect()
        assert all(r.near == (distance(r.a, r.b) <= min(edits, min(len(r.a), len(r.b)) // 20)) for r in got)


def test_lines_three_substitutions_apart(spark):
    """Six bits of their signatures differ."""
    a = "the quick brown fox jumps over it"
    b = a.replace("quick", "quack").replace("fox", "fux").replace("over", "ovir")
    for edits, kept in ((2, 2), (3, 1)):
        got = lines.kept_lines(docs(spark, [(1, a), (2, b), (3, "buy now\nbuy now")]), edits)
        assert got.where("kept and doc_id < 3").count() == kept and got.where("kept and doc_id = 3").count() == 1


@pytest.mark.parametrize("edits", [1, 2, 3, 4])
def test_whole_line_dedup(spark, edits):
    """Exact repeats of short lines go, and all edits hold from 20 characters; by brute force."""
    rng = random.Random(20 + edits)
    base = ["".join(rng.choice("abcdeé ") for _ in range(rng.choice((20, 21, 25, 39, 60)))) for _ in range(8)]
    rows = [(
        i,
        "\n".join(rng.choice((
            edited(rng, rng.choice(base), rng.choice((0, 0, 1, 2, 3, edits + 1))), "}", "ok", "",
        )) for _ in range(rng.randrange(1, 8))),
    ) for i in range(25)]
    rows += [(30, None), (31, ""), (32, "short\nshort"), rows[2], (None, rows[0][1])]
    seen = {(i, p): line for i, t in rows if i is not None and t is not None for p, line in enumerate(t.split("\n"))}
    different = sorted({s for s in seen.values() if s})
    cls = {s: s for s in different}

    def root(s):
        while cls[s] != s:
            s = cls[s]
        return s

    for p, a in enumerate(different):
        for b in different[:p]:
            if min(len(a), len(b)) >= 20 and distance(a, b) <= edits:
                cls[root(a)] = root(b)
    first, lead, want = {}, {}, {}
    for at in sorted(seen):
        s = seen[at]
        if s:
            first.setdefault(s, at)
            lead.setdefault(root(s), at)
        want[at] = (not s or lead[root(s)] == at, bool(s) and first[s] != at)
    got = lines.kept_lines(docs(spark, rows), edits, whole=True).select("doc_id", "pos", "kept", "exact").distinct().collect()
    assert {(r[0], r[1]): (r[2], r[3]) for r in got} == want
    digest = {r.doc_id: r.n_exact for r in lines.line_digest(docs(spark, rows), edits).collect()}
    assert digest[32] == 1 and all(n >= sum(e for (i, _), (_, e) in want.items() if i == d) for d, n in digest.items())


def test_signature_bound(spark):
    rng = random.Random(7)
    pairs = []
    for _ in range(200):
        a = "".join(rng.choice("etab. zé") for _ in range(rng.randrange(20, 60)))
        pairs.append((a, edited(rng, a, 2)))
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select(F.bit_count(lines.signature(df.a).bitwiseXOR(lines.signature(df.b))).alias("n")).collect()
    assert all(r.n <= 4 for r in got)


def test_one_doc_id_on_two_texts(spark):
    """Lines are verified by their own texts where another text has the same doc_id and position."""
    line = lambda n: " ".join(f"number{n}{c}" for c in "abcde")
    rows = []
    for n in range(12):
        near = line(n)[:-1] + "z"
        two = [(n, f"{line(n)}\nends {n}"), (n, f"{line(n + 500)}\nstops {n}")]
        rows += [*(two if n % 2 else two[::-1]), (100 + n, near)]
    got = {r.doc_id: r.n_near for r in lines.line_digest(docs(spark, rows)).where("doc_id >= 100").collect()}
    assert got == {100 + n: 1 for n in range(12)}


@pytest.mark.parametrize(("edits", "whole"), [(2, True), (1, True), (2, False)])
def test_common_segments_are_refined(spark, monkeypatch, edits, whole):
    """Many lines that share segments, by brute force: classes, near and kept lines and the digest."""
    monkeypatch.setattr(lines, "BUCKET", 2)
    rng = random.Random(50 + edits)
    bases = ["".join(rng.choice("abcdeé fghij") for _ in range(n)) for n in (20, 27, 44, 90)]
    pool = [edited(rng, rng.choice(bases), rng.choice((0, 1, 1, 2, 3, 4))) for _ in range(90)]
    pool += [f"order {rng.randrange(3000):06d} was shipped to the customer on day {rng.randrange(9)}" for _ in range(50)]
    rows = [(i, "\n".join(rng.sample(pool, 3))) for i in range(70)]
    seen = {(i, p): line for i, t in rows for p, line in enumerate(t.split("\n"))}
    different = sorted(set(seen.values()))
    cls = {s: s for s in different}

    def root(s):
        while cls[s] != s:
            s = cls[s]
        return s

    for p, a in enumerate(different):
        for b in different[:p]:
            n = min(len(a), len(b))
            if n >= 20 and abs(len(a) - len(b)) <= edits and root(a) != root(b) and distance(a, b) <= (edits if whole else min(edits, n // 20)):
                cls[root(a)] = root(b)
    first, lead, want = {}, {}, {}
    for at in sorted(seen):
        s = seen[at]
        first.setdefault(s, at)
        lead.setdefault(root(s), at)
        exact = first[s] != at and (whole or len(s) >= 20)
        want[at] = (lead[root(s)] == at or (len(s) < 20 and not exact), exact)
    got = lines.kept_lines(docs(spark, rows), edits, whole=whole).collect()
    assert {(r.doc_id, r.pos): (r.kept, r.exact) for r in got} == want
    digest = {r.doc_id: (r.n_lines, r.n_exact, r.n_near, r.kept_sha256) for r in lines.line_digest(docs(spark, rows), edits, whole=whole).collect()}
    for i, _ in rows:
        mine = [want[i, p] for p in range(3)]
        at = ",".join(str(p) for p, (kept, _) in enumerate(mine) if kept)
        assert digest[i] == (3, sum(e for _, e in mine), sum(not k and not e for k, e in mine), hashlib.sha256(at.encode()).hexdigest())


def test_names_that_clash(spark):
    df = docs(
        spark, [(1, "one line here\none line here"), (2, None), (None, "x\nx")],
    ).withColumns({"_id": F.lit(5), "_gone": F.lit("g"), "a": F.lit(1), "line": F.lit("l"), "pos": F.lit(0)})
    got = lines.dedup_lines(df, whole=True)
    assert got.columns == df.columns
    assert {r.doc_id: (r.text, r._id, r._gone) for r in got.collect()} == {1: ("one line here", 5, "g"), 2: (None, 5, "g"), None: ("x\nx", 5, "g")}


@pytest.mark.parametrize("nodes", [0, 200_000])
def test_components_with_few_and_many_nodes(spark, monkeypatch, nodes):
    """Rounds of few edges take few tasks, however many shuffle partitions there are; both forms of a round agree with union-find."""
    monkeypatch.setattr(graph, "NODES", nodes)
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 130)] + [(7, i) for i in range(200, 400)]
    edges += [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(120)] + [(5, 5), (None, 3)]
    lead = {}

    def find(x):
        while lead.setdefault(x, x) != x:
            x = lead[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            low, high = sorted((find(a), find(b)))
            lead[high] = low
    before = spark.conf.get("spark.sql.shuffle.partitions")
    off = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        got = graph.components(spark.createDataFrame(edges, "a long, b long").coalesce(2))
        assert got.rdd.getNumPartitions() <= graph.FEW_TASKS
        assert sorted(map(tuple, got.collect())) == sorted((x, find(x)) for x in lead)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize(("edits", "least"), [(1, None), (2, None), (2, 20), (4, 20)])
def test_line_keys(spark, capsys, edits, least):
    """Lines within the edits share a key, no key is made twice, and the keys' code is short enough for the JVM to compile."""
    rng = random.Random(60 + edits)
    pairs = []
    for i in range(150):
        a = "".join(rng.choice("abc é"[: rng.choice((4, 5))]) for _ in range(rng.choice((20, 21, 39, 40, 41, 60, 83))))
        b = edited(rng, a, rng.randrange(edits + 1))
        pairs += [(2 * i, min(a, b, key=len)), (2 * i + 1, max(a, b, key=len))]
    df = spark.createDataFrame(pairs, "a long, line string")
    keys = lines.line_keys(df, edits, least)
    rows, own = keys.collect(), lines.line_keys(df, edits, least, own=True).collect()
    assert len({(r.place, r.a) for r in rows}) == len(rows) and set(own) <= set(rows)
    have, index = {(r.a, r.key) for r in rows}, {}
    for r in own:
        index.setdefault(r.a, set()).add(r.key)
    near = 0
    for (x, a), (y, b) in zip(pairs[::2], pairs[1::2], strict=True):
        if len(a) >= 20 and distance(a, b) <= (edits if least else min(edits, len(a) // 20)):
            near += 1
            assert any((y, k) in have for k in index[x])
    assert near > 50
    keys.explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000
