"""Fill-in-middle against plain Python, and exact round trips."""

import hashlib
import random
import re

import pytest

from common import docs
from framelake.llm import fim


def plain(doc_id, text, seed=7, rate=100, spm=50, marks=fim.SENTINELS):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in marks) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < spm:
        return doc_id, n, "spm", len(p), len(m), marks[1] + s + marks[0] + p + marks[2] + m
    return doc_id, n, "psm", len(p), len(m), marks[0] + p + marks[1] + s + marks[2] + m


def rows():
    rng = random.Random(5)
    out = [(i, "".join(rng.choices(("a", "é", "\n", "\n\n", "𝔘x", "<P", "S>", "<", "\r", "\0", " "), k=rng.randrange(30)))) for i in range(150)]
    out += [
        (200, None), (201, ""), (202, "\n"), (203, "no end"), (204, "a<P>b"), (205, "<S>"), (206, "x<M>"), (None, "a\nb\nc"),
        (207, "line\n" * 100_000), (208, "é" * 500_000),
    ]
    return [*out, out[0], out[3]]


@pytest.mark.parametrize("rate, spm, marks", [(100, 50, fim.SENTINELS), (60, 0, ("[p]", "[suffix]", "[m]")), (100, 100, ("¡é", "¢x", "£"))])
def test_fill_in_middle(spark, rate, spm, marks):
    given = rows()
    made = fim.fill_in_middle(docs(spark, given), 7, rate, spm, marks)
    want = sorted((plain(i, t, 7, rate, spm, marks) for i, t in given), key=repr)
    got = made.collect()
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=repr) == want
    assert all(r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest() for r in got)
    texts = {}
    for i, t in given:
        texts.setdefault(i, set()).add(t or "")
    buffers = [m.encode() for m in marks]
    for r in fim.restore(made, marks).collect():
        assert r.restored in texts[r.doc_id] and r.restored_sha256 == hashlib.sha256(r.restored.encode()).hexdigest()
        whole = (r.restored.encode(), *buffers)
        assert b"".join(whole[p.buffer][p.start : p.start + p.length] for p in r.pieces) == r.output.encode()
    hashes = fim.fill_in_middle(docs(spark, given), 7, rate, spm, marks, texts=False).select("doc_id", "output", "output_sha256").collect()
    assert {r.output for r in hashes} == {None} and sorted(r.output_sha256 for r in hashes) == sorted(r.output_sha256 for r in got)


def test_cutting_and_odd_input(spark):
    assert fim.cut([(0, 0, 5), (0, 5, 3)], 6) == [(0, 0, 5), (0, 5, 1), (0, 6, 2)] and fim.cut([(0, 0, 5)], 5) == [(0, 0, 5)]
    assert fim.thirds(5, 0, 5) == [(0, 0, 0), (0, 0, 5), (0, 5, 0)] and fim.thirds(5, 2, 2) == [(0, 0, 2), (0, 2, 0), (0, 2, 3)]
    for bad in (("<P>", "", "<M>"), ("<P>", "<P>", "<M>"), ("<P>", "x<P>", "<M>"), ("ab", "bc", "d"), ("aba", "c", "d")):
        with pytest.raises(ValueError, match="sentinels"):
            fim.check_sentinels(bad)
    assert fim.restore(fim.fill_in_middle(docs(spark, []))).count() == 0
    again = fim.restore(fim.restore(fim.fill_in_middle(docs(spark, [(1, "a\nb")])))).first()
    assert again.restored == "a\nb"
    for form, output in (("psm", b"<P>a<M>b"), ("psm", b"x<P>a<S>b<M>")):
        with pytest.raises(ValueError):
            fim.find_parts(output, form, (b"<P>", b"<S>", b"<M>"))
