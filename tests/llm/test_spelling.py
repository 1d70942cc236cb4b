"""Spelling variants against plain Python."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from common import docs
from framelake.llm import spelling


def plain_counts(rows, least=6, count=5, every=199):
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                seen[run] += 1
    return {w: n for w, n in seen.items() if n >= count}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows, ratio=5, **how):
    n = plain_counts(rows, **how)
    form, near = {}, {}
    for w in n:
        close = [v for v in n if is_near(w, v)]
        near[w] = len(close)
        best = min(close, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], near[w], n[form[w]] if form[w] else None))
    return sorted(out)


def given(seed):
    rng = random.Random(seed)
    letters = "abcéÿ×À"
    words = ["".join(rng.choices(letters, k=rng.choice((5, 6, 6, 7, 8)))) for _ in range(25)]
    words += ["zabcdefgh", "zabcdefgi", "zabcdefg", "zabcdef", "xzabcdefg"]
    for w in words[:]:
        for _ in range(4):
            i = rng.randrange(len(w))
            words.append(rng.choice((w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :], w.upper())))
    rows = []
    for d in range(80):
        picked = [words[int(len(words) * rng.random() ** 2.5)] for _ in range(60)]
        rows.append((d, "".join(w + rng.choice((" ", "-", "1", "ā", "\n", "'")) for w in picked)))
    rows += [(504, "chainword " * 200 + "chainworx " * 30 + "chainwoxx " * 6)]
    return [
        *rows, (500, None), (501, ""), (502, " 12 ā"), (None, "zabcdefgh " * 30), rows[0],
        (503, ("q" * 3000 + " ") * 6 + ("q" * 3001 + " ") * 40),
    ]


@pytest.mark.parametrize("seed, most", [(1, 32), (2, 1)])
def test_spelling_variants(spark, seed, most):
    rows = given(seed)
    got = sorted(tuple(r) for r in spelling.spelling_variants(docs(spark, rows), most=most).collect())
    assert got == plain(rows) and sum(r[1] is not None for r in got) > 5 and ("chainwoxx", "chainworx", "chainword") in [r[:3] for r in got]


def test_spelling_parameters_and_odd_input(spark):
    rows = given(3)[:40]
    got = spelling.spelling_variants(docs(spark, rows), 3, 2, 2, 0).collect()
    assert sorted(map(tuple, got)) == plain(rows, 2, least=3, count=2, every=0)
    assert spelling.spelling_variants(docs(spark, [])).count() == 0
    assert spelling.spelling_variants(docs(spark, [(1, None), (2, "a b")])).count() == 0
    with pytest.raises(ValueError, match="ratio"):
        spelling.spelling_variants(docs(spark, []), ratio=1)


def test_sums_and_neighbourhoods():
    rng = random.Random(0)
    words = [bytes(rng.choices(range(97, 123), k=rng.randrange(1, 200))) for _ in range(50)]
    raw = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    before = np.array([zlib.crc32(b"%d:" % i) for i in range(50)], np.uint32)
    assert spelling.run_sums(raw, ends - [len(w) for w in words], ends, before).tolist() == [zlib.crc32(b"%d:" % i + w) for i, w in enumerate(words)]
    for symbols in spelling.ALPHABETS:
        table = spelling.reduction(symbols)
        for word in (b"a", b"aab", b"zebra\xe9"):
            codes = np.frombuffer(word, np.uint8)[None]
            keys, counts = spelling.neighbourhood(codes, table, symbols)
            s = tuple(table[codes[0]].tolist())
            want = {s} | {s[:i] + s[i + 1 :] for i in range(len(s))} | {s[:i] + (t,) + s[i + j :] for j in (0, 1) for i in range(len(s) + 1) for t in range(
                1, symbols + 1,
            ) if i + j <= len(s)}
            assert len(keys) == counts[0] == len(want)
    assert len(set(spelling.reduction(90)[spelling.LETTERS].tolist())) == 90
