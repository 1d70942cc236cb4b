"""Operators on single texts, against plain Python."""

import hashlib
import math
import random
import re
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from common import corpus, docs, words
from framelake.llm import decontam, fm_index, katz, licenses, mixing, ogg, quality, secrets, tokens
from framelake.llm.queries import tokenizer_path


def lower(t):
    return "".join(c.lower() if c.isascii() else c for c in (t or ""))


# --- benchmark decontamination


def test_fm_index():
    rng = np.random.default_rng(0)
    runs = [rng.integers(1, 6, int(n)) for n in rng.integers(1, 40, 30)]
    off = np.concatenate(([0], np.cumsum([len(r) for r in runs])))
    index = fm_index.FMIndex(np.concatenate(runs), off)
    patterns = np.zeros((60, 5), np.int64)
    lengths = rng.integers(1, 6, 60)
    for i, n in enumerate(lengths):
        patterns[i, 5 - n :] = rng.integers(1, 8, n)
    lo, hi = index.search(patterns, lengths)
    for p, n, a, b in zip(patterns, lengths, lo, hi, strict=True):
        want = sorted(int(index.start[r]) + j for r, run in enumerate(runs) for j in range(len(run) - n + 1) if (run[j : j + n] == p[5 - n :]).all())
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def hits(rows, items, width):
    cut = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", lower(t))
    windows = {}
    for i, t in items:
        w = cut(t)
        if w:
            n = min(len(w), width)
            for j in range(len(w) - n + 1):
                windows.setdefault(tuple(w[j : j + n]), set()).add(i)
    out = []
    for d, t in rows:
        w, hit, found = cut(t), set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit |= set(range(j, j + n))
                    found |= windows[tuple(w[j : j + n])]
        found.discard(None)  # hits words, but has no name
        ids = ",".join(sorted(map(str, found)))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_chars", [1 << 20, 200])
def test_decontamination(spark, block_chars):
    rng = random.Random(1)
    items = [(i, words(rng, 14, 60)) for i in range(12)] + [
        (20, "w1 w2"), (21, None), (22, ""), (None, "w3 w4 w5"), (3, words(rng, 11, 60)), (23, "Été—w9"),
    ]
    rows = corpus(4, 20)
    for i in range(30, 40):
        piece = rng.choice(items[:12])[1].upper().replace(" ", ", ")
        rows.append((i, f"{words(rng, 20)} {piece}! {words(rng, 5)} été w9"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = docs(spark, [(a, b) for a, b in rows])
    found = decontam.benchmark_hits(df, bench, 10, keep_text=True, block_chars=block_chars)
    assert sorted(map(tuple, decontam.hit_digest(found).collect()), key=repr) == hits(rows, items, 10)
    clean = decontam.without_spans(found)
    again = decontam.hit_digest(decontam.benchmark_hits(clean, bench.where("item_id < 20"), 10))
    assert clean.count() == len(rows) and again.where("n_words > 0").count() > 0
    kept = decontam.decontaminate(df, bench)
    assert kept.columns == df.columns and sorted([r.doc_id for r in kept.collect()], key=repr) == sorted(
        [h[0] for h in hits(rows, items, 10) if not h[5]], key=repr,
    )
    assert decontam.hit_digest(decontam.benchmark_hits(docs(spark, []), bench)).count() == 0
    assert decontam.benchmark_hits(df, bench.where("false")).where("size(spans) > 0").count() == 0


# --- mixing


def test_water_filling_and_mixture(spark):
    rng = random.Random(2)
    rows = [(i, words(rng, rng.randrange(1, 30)), rng.choice(["a", "a", "a", "b", "é", None])) for i in range(400)] + [
        (900, None, "a"), (901, "", "z"), (902, "x y", "Z"), (5, "again", "a"), (None, "no id", "b"),
    ]
    df = docs(spark, rows)
    got = mixing.mixture_table(df).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mixture_table(df.repartition(7)).collect()), key=repr)
    total = sum(r.size for r in got)
    names = sorted({r[2] for r in rows if r[2] is not None}, key=lambda s: s.encode()) + [None]
    size = {s: sum(len((t or "").split()) for _, t, q in rows if q == s) for s in names}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    capped, target = set(), {}
    while True:
        left = {s for s in names if s not in capped}
        level = (1.5 * total - sum(2 * size[s] for s in capped)) / sum(weight[s] for s in left) if left else 0
        over = {s for s in left if weight[s] * level >= 2 * size[s]}
        if not over:
            break
        capped |= over
    for s in names:
        target[s] = 2 * size[s] if s in capped else weight[s] * level
    assert sum(target.values()) == pytest.approx(1.5 * total)
    by_id = {(d, t): s for d, t, s in rows}
    del by_id
    assert sorted({round(r.target, 6) for r in got}) == sorted({round(x, 6) for x in target.values()})
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    for s in names:
        mine = [r for r in got if r.source_size == size[s] and abs(r.target - target[s]) < 1e-6]
        assert abs(sum(r.taken for r in mine) / max(1, len({(r.source_size) for r in mine})) - target[s]) <= 30
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    assert sum(len((r.text or "").split()) for r in mixed.collect()) == sum(r.taken for r in got)
    assert mixing.mixture_table(docs(spark, [])).count() == 0 and mixing.mix(docs(spark, [])).count() == 0
    assert [r.taken for r in mixing.mixture_table(docs(spark, [(1, None), (2, "")])).collect()] == [0, 0]


# --- token output


@pytest.mark.parametrize("bits", [False, True])
def test_planes(bits):
    for n in (0, 1, 7, 8, 9, 8191, 8192, 20_001):
        ids = np.random.default_rng(n).integers(0, 2**32, n).astype(np.uint32)
        planes = tokens.to_planes(ids, bits)
        assert len(planes) == (32 if bits else 4) and (tokens.from_planes(planes, n) == ids).all()


def test_token_output(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    odd = ["a  b", "x　y 　 z", "don't  ITS 'll", " a", "a ", "<|endoftext|> b", "tab\t x\n\n y", "é  q", "  x 1 22"]
    rows = corpus(6, 25) + [(200 + i, t) for i, t in enumerate(odd)]
    stored = tokens.write_ids(docs(spark, rows), tokenizer_path(), chunk=500)
    got = sorted(tokens.read_index(stored).collect(), key=lambda r: r.start)
    want = sorted(((i if i is not None else -1, t or "") for i, t in rows))
    start = 0
    for r, (i, t) in zip(got, want, strict=True):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        assert (r.doc_id if r.doc_id is not None else -1, r.start, r.n_tokens) == (i, start, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert tokens.read_ids(stored).count() == len(rows) and stored.count() > 3
    assert tokens.read_index(tokens.write_ids(docs(spark, []), tokenizer_path())).count() == 0


# --- secrets


def plain_secrets(t):
    t, base = t or "", []
    for m in re.finditer(secrets.ASSIGN[4:], t, re.I | re.A):
        if len(m[2]) >= 12:
            base.append((m.start(), 0, m.end()))
    base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 18]
    base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 16]
    more = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]+", t):
        s = m[0]
        if len(s) < 20 or not re.search("[0-9]", s) or not re.search("[A-Za-z]", s) or any(re.fullmatch(p, s) for p in secrets.ALLOWED):
            continue
        least = next(b for _, p, b in secrets.CLASSES if re.fullmatch(p, s))
        hot = [i for i in range(len(s) - 19) if -sum(s[i : i + 20].count(c) / 20 * math.log2(s[i : i + 20].count(c) / 20) for c in set(s[i : i + 20])) >= least]
        if hot and not any(a < m.start() + hot[-1] + 20 and m.start() + hot[0] < b for a, _, b in base):
            more.append((m.start() + hot[0], 3, m.start() + hot[-1] + 20))
    said = lambda x: ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(x))
    return [sum(k == n for _, k, _ in base) for n in range(3)] + [hashlib.sha256(said(base).encode()).hexdigest(), said(base + more)]


def test_secrets(spark):
    rng = random.Random(8)
    key = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    al, hx = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "0123456789abcdef"
    texts = [
        None, "", "é password = hunter2hunter2 ü", "PassWord:'short' token: token=abcdefghijklmnop",
        f"api_key=\"{key(40, al)}\" x {key(40, hx)}", f"AKIA{key(16, al[:26])} AKIASHORT AKIAAKIAAKIA{key(9, al[:26])}",
        f"ü {key(30, al)}. {key(24, al)}", "123e4567-e89b-12d3-a456-426614174000", "example0123456789abcdefghijklmnop", "9" * 50,
        "/usr/local/share/some/file/name1", f"{'a' * 30}{key(25, al)}{'b' * 30}1", "deadbeef" * 4,
        "secret" * 10 + " = " + key(20, al), key(3000, al), " ".join(key(22, al) for _ in range(60)),
    ]
    rows = list(enumerate(texts)) + [(2, texts[2]), (None, texts[4])]
    df = docs(spark, rows)
    got = secrets.secret_digest(df).collect()
    assert sorted([list(r)[1:] for r in got], key=repr) == sorted([plain_secrets(t) for _, t in rows], key=repr)
    assert any("entropy" in r.spans for r in got)
    clean = secrets.redact(df)
    assert clean.columns == df.columns and "hunter2" not in str(clean.where("doc_id = 2").first().text)
    assert secrets.secret_digest(docs(spark, [])).count() == 0


def test_long_candidates(spark):
    """Runs of 100 kB and 1 MB end in seconds, without deep recursion; long ones by brute force as well."""
    rng = random.Random(18)
    al = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
    run = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    texts = [
        "a/" * 50_000 + "b1", run(1_000_000, re.sub("[mxMX]", "", al)),
        "x " + run(3000, al) + "\u00fc " + run(900, "ab1" * 3 + al), "z9" + "aab" * 700 + run(40, al),
        " ".join(run(16, "0123456789abcdef") for _ in range(3000)),
    ]
    df = docs(spark, list(enumerate(texts)))
    began = time.time()
    got = {r.doc_id: list(r)[1:] for r in secrets.secret_digest(df).collect()}
    assert time.time() - began < 60
    for i in (0, 2, 3, 4):
        assert got[i] == plain_secrets(texts[i])
    assert got[1][4].startswith("entropy:0:") and got[0][4] == ""
    assert len(secrets.redact(df).where("doc_id = 1").first().text) < 100


def test_secrets_of_clashing_names(spark):
    df = docs(spark, [(1, "password = hunter2hunter2"), (2, None)]).withColumns({
        "secrets": F.lit("s"), "_base": F.lit(1), "_hot": F.lit(2), "_s0": F.lit(3), "_s3": F.lit(4),
    })
    got = secrets.redact(df)
    assert got.columns == df.columns
    assert {(r.doc_id, r.text, r.secrets, r._base, r._hot, r._s0, r._s3) for r in got.collect()} == {
        (1, "[secret]", "s", 1, 2, 3, 4), (2, None, "s", 1, 2, 3, 4),
    }


# --- quality


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.quality_scores(d, labels).join(labels, "doc_id").where("held_out").select("quality", "predicted").collect()
    assert np.mean([r.quality == r.predicted for r in got]) > 0.95
    model = quality.learn(d, labels)
    odd = docs(spark, [(1, None), (2, ""), (None, "x"), (3, "word " * 30_000), (4, "A B"), (4, "A B")])
    scores = [r.s for r in quality.with_score(odd, model, "s").collect()]
    assert len(scores) == 6 and all(0 <= s <= 1 for s in scores) and scores[4] == scores[5]
    rows = d.limit(50)
    x = np.array(rows.select(*[c.cast("double").alias(k) for k, c in quality.statistics(rows.text).items()]).collect())
    assert np.allclose(model.score(x), [r.s for r in quality.with_score(rows, model, "s").collect()])
    none = labels.where("false")
    assert {r.score for r in quality.quality_scores(odd, none).collect()} == {0.5}
    assert quality.quality_scores(docs(spark, []), labels).count() == 0
    kept = quality.keep_good(odd, labels)
    assert kept.columns == odd.columns


def test_learning_counts_a_document_once(spark):
    sf = "/root/testdata/sf0.001"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.learn(d, labels)
    assert model.rules
    hot = d.join(labels, "doc_id", "left_semi").where(~quality.held_out(d.doc_id)).orderBy("doc_id").limit(1)
    many = d.unionByName(hot.crossJoin(spark.range(3000).select()))
    again = labels.unionByName(labels.join(hot.select("doc_id"), "doc_id", "left_semi").select(labels.columns).crossJoin(spark.range(300).select()))
    assert quality.learn(many, again) == model


# --- language model


def plain_katz(rows):
    cut = lambda t: [*lower(t).split(), "</s>"]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    uni, pair, ctx = {}, {}, {}
    for i, t in rows:
        if not held(i):
            w = cut(t)
            for a, b in zip(["<s>", *w], w, strict=False):
                uni[b] = uni.get(b, 0) + 1
                pair[a, b] = pair.get((a, b), 0) + 1
                ctx[a] = ctx.get(a, 0) + 1
    n, v = sum(uni.values()), len(uni)
    z = n + v + 1
    hist = np.array([sum(r == k for r in pair.values()) for k in range(1, katz.GT + 2)])
    d = katz.discounts(hist)
    weight = lambda r: d[r] * r if r <= katz.GT else r - 0.5
    p_uni = lambda w: (uni.get(w, 0) + 1) / z
    alpha, after = {}, {}
    for a, b in pair:
        after.setdefault(a, []).append(b)
    for h, c in ctx.items():
        seen = after[h]
        alpha[h] = (1 - sum(weight(pair[h, w]) for w in seen) / c) / (1 - sum(p_uni(w) for w in seen))
        if len(alpha) > 40:
            continue
        unknown = alpha[h] / z  # all unknown words
        whole = sum(weight(pair[h, w]) / c if (h, w) in pair else alpha[h] * p_uni(w) for w in uni) + unknown
        assert whole == pytest.approx(1)
    out = []
    for i, t in rows:
        w = cut(t)
        p = [weight(pair[a, b]) / ctx[a] if (a, b) in pair else alpha.get(a, 1.0) * p_uni(b) for a, b in zip(["<s>", *w], w, strict=False)]
        out.append((i, held(i), len(w), sum(b in uni for b in w), n, sum(math.log10(p_uni(b)) for b in w), sum(map(math.log10, p))))
    return out


@pytest.mark.parametrize("block_chars", [12_000_000, 20_000])
def test_katz(spark, block_chars):
    rows = corpus(11, 50)
    got = sorted(map(tuple, katz.katz_scores(docs(spark, rows), block_chars).collect()), key=repr)
    want = sorted(plain_katz(rows), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want])
    assert katz.katz_scores(docs(spark, [])).count() == 0


def test_katz_without_training_rows(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = katz.katz_scores(docs(spark, [(held, "a b")])).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)


# --- media


def test_ogg_round_trip():
    rng = random.Random(0)
    for n in (0, 1, 191, 192, 193, 4096, 65_025, 66_000, 300_000):
        raw = ogg.padded(bytes(rng.randrange(256) for _ in range(n)))
        data = ogg.encode(raw)
        samples, f = ogg.decode(data)
        assert samples == raw and f["peak"] == max(raw) and f["streams"] == 2 and f["packets"] == -(-len(raw) // ogg.PACKET)
    packets = [(b"h", 0), (b"x" * 255, 1), (b"", 2), (b"y" * 200_000, 3), (b"z" * 510, 4)]
    w = ogg.StreamWriter(9)
    w.packets(packets)
    assert [p for p, _ in ogg.demux(b"".join(w.pages))[9]] == [p for p, _ in packets]
    for bad in (data[:-1], data[1:], data[:100] + bytes([data[100] ^ 1]) + data[101:], b"".join(w.pages[:-1]), b"".join([w.pages[0], *w.pages[2:]])):
        with pytest.raises(ogg.OggError):
            ogg.demux(bad)


def test_ogg_crc():
    def slow(data):
        crc = 0
        for b in data:
            crc ^= b << 24
            for _ in range(8):
                crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
        return crc

    for data in (b"", b"OggS", bytes(range(256))):
        assert ogg.page_crc(data) == slow(data)


def test_media_columns(spark):
    rows = corpus(12, 12)
    got = {r.doc_id: r for r in ogg.media_features(ogg.text_to_media(docs(spark, rows))).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        p = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert r.media_sha256 == hashlib.sha256(ogg.encode(p)).hexdigest()
    assert ogg.media_features(ogg.text_to_media(docs(spark, []))).count() == 0


# --- licenses


def test_patience():
    assert licenses.longest_increasing([3, 1, 2, 5, 4]) in ([1, 2, 4], [1, 2, 3])
    assert licenses.longest_increasing([]) == []
    rng = random.Random(4)
    for _ in range(50):
        a = [rng.randrange(30) for _ in range(20)]
        b = [x for x in a if rng.random() < 0.8]
        pairs = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    assert len(licenses.patience(list("abcdef"), list("abxdef"))) == 5


def test_license_scan(spark):
    mit = licenses.TEMPLATES["mit"]
    broken = " ".join(w for i, w in enumerate(mit.split()) if i % 12)
    rng = random.Random(5)
    texts = [
        None, "", "the mit license under of", f"{words(rng, 50)}\nReleased under the MIT License.\n{words(rng, 9)}", mit.upper(),
        f"{words(rng, 9)} {broken} {words(rng, 3000)}", f"{mit} x {mit}", "Licensed under CC BY-NC 4.0. " * 3,
        "This work is licensed under the GNU General Public License, version 3.",
    ]
    rows = [*enumerate(texts), (3, texts[3]), (None, texts[8])]
    got = licenses.license_hits(docs(spark, rows)).collect()
    found = {}
    for r in got:
        found.setdefault(r.doc_id, []).append(r.license)
    assert not {0, 1, 2} & set(found)
    assert found[3] == ["mit-notice"] * 2 and found[4] == ["mit"] and found[5] == ["mit"] and found[6] == ["mit"] * 2
    assert found[7].count("cc-by-nc-4.0-notice") == 3 and "gpl-3.0-notice" in found[8] and None in found
    r = next(r for r in got if r.doc_id == 3)
    assert (r.coverage, r.matched, r.start_word, r.end_word) == (1.0, 5, 50, 55)
    assert licenses.license_hits(docs(spark, [])).count() == 0
    twice = [(1, "The under. " + "Released under the MIT License. " * 2), (2, "the under license released mit " * 40)]
    assert licenses.license_hits(docs(spark, twice)).where("doc_id = 1").count() == 2


def test_license_scan_across_inserted_passages(spark):
    """One passage of 6 to 50 foreign words in a text: the same coverage as an alignment of the whole text."""
    rng, rows, want = random.Random(6), [], {}
    plain = ["of", "the", "and", "to", "in", "a", "this", "is", "for", "with"]
    cut = lambda t: re.findall("[0-9a-z]+", lower(t))
    for name in ("mit", "bsd-3-clause", "gpl-3.0-header", "apache-2.0-header", "isc"):
        whole = cut(licenses.TEMPLATES[name])
        for n in (6, 7, 20, 50):
            for common in (False, True):
                at = rng.randrange(len(whole) // 3, 2 * len(whole) // 3)
                more = [rng.choice(plain) if common and rng.random() < 0.4 else f"x{rng.randrange(999)}" for _ in range(n)]
                text = [*whole[:at], *more, *whole[at:]]
                want[len(rows)] = (name, len(licenses.patience(whole, text)), 30, 30 + len(text))
                around = [[rng.choice(plain) if common else f"w{rng.randrange(400)}" for _ in range(m)] for m in (30, 300)]
                rows.append((len(rows), " ".join([*around[0], *text, *around[1]])))
    got = {(r.doc_id, r.license): (r.license, r.matched, r.start_word, r.end_word) for r in licenses.license_hits(docs(spark, rows)).collect()}
    assert all(w[1] == len(cut(licenses.TEMPLATES[w[0]])) for w in want.values())
    assert {i: got.get((i, w[0])) for i, w in want.items()} == want


def common_words(a, b):
    """Length of a longest common subsequence, by the plain table."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_whole_licenses_by_plain_alignment(spark):
    """Licenses with words lost, changed and put in, between other words: found exactly where a plain alignment has enough."""
    rng = random.Random(41)
    cut = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", lower(t))
    names, rows, want = sorted(licenses.TEXTS), [], {}
    for i in range(36):
        name = names[i % len(names)]
        w = cut(licenses.TEXTS[name])
        lost = rng.choice((0.0, 0.05, 0.15, 0.3, 0.5))
        kept = [x if rng.random() > 0.03 else f"z{rng.randrange(99)}" for x in w if rng.random() >= lost]
        for _ in range(rng.choice((0, 4, 12))):
            kept.insert(rng.randrange(len(kept) + 1), f"y{rng.randrange(99)}")
        text = [f"w{rng.randrange(500)}" for _ in range(60)] + kept + [f"w{rng.randrange(500)}" for _ in range(60)]
        rows.append((i, " ".join(text).upper()))
        for other in names:
            n = common_words(cut(licenses.TEXTS[other]), kept)
            if n >= math.ceil(licenses.COVERAGE * len(cut(licenses.TEXTS[other]))):
                want[i, other] = n
    got = {(r.doc_id, r.license): r.matched for r in licenses.license_hits(docs(spark, rows), licenses.TEXTS).collect()}
    assert got == want and 15 < len(want) < 50


def test_lcs():
    rng = random.Random(9)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 15))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        places = {}
        for i, x in enumerate(a):
            places[x] = places.get(x, 0) | 1 << i
        pairs = licenses.lcs(a, places, b)
        assert len(pairs) == table[-1][-1] == len(a) - licenses.lcs_rows(places, len(a), b)[-1].bit_count()
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


@pytest.mark.parametrize("greatest", [1, 3, 7])
def test_fm_index_symbol_above_the_greatest(greatest):
    """A word that a shard does not have has no occurrence, also where its symbol needs a bit more."""
    runs = [np.arange(1, greatest + 1), np.full(3, greatest)]
    off = np.concatenate(([0], np.cumsum([len(r) for r in runs])))
    index = fm_index.FMIndex(np.concatenate(runs), off)
    patterns = np.array([[0, greatest + 1], [greatest + 1, greatest], [greatest, greatest + 1], [0, greatest]])
    lo, hi = index.search(patterns, np.array([1, 2, 2, 1]))
    assert (hi - lo).tolist() == [0, 0, 0, 4]


def test_decontaminate_by_rows_without_id(spark):
    """A benchmark row whose item_id is null takes documents out like any other."""
    bench = spark.createDataFrame([(None, "red green blue"), (1, "one two"), (2, None)], "item_id long, text string")
    rows = [(1, "a Red, green blue b"), (2, "one two three"), (3, "green blue red"), (4, None)]
    assert sorted(r.doc_id for r in decontam.decontaminate(docs(spark, rows), bench).collect()) == [3, 4]


def test_long_items_in_pieces(spark):
    """Every window of a long item lies in a piece, and no piece makes a window of its own."""
    rng = random.Random(31)
    long_item = words(rng, 200, 40)
    bench = spark.createDataFrame([(1, long_item), (2, "w1 w2"), (3, None), (4, words(rng, 12, 40))], "item_id long, text string")
    for size in (1, 3, 50, 190, 191, 192, 500):
        got = {r.text for r in decontam._pieces(bench.where("item_id = 1"), 10, size).collect()}
        cut = lambda t: {tuple(t.split()[i : i + 10]) for i in range(len(t.split()) - 9)}
        assert set().union(*map(cut, got)) == cut(long_item) and all(len(t.split()) >= 10 for t in got)


def test_repeated_benchmark_rows_share_a_block(spark, monkeypatch):
    """Blocks hold different pieces, however often rows are repeated; a block's characters stay near the bound."""
    rng = random.Random(9)
    texts = [words(rng, 40) for _ in range(60)]
    bench = spark.createDataFrame([(i % 20, t) for i, t in enumerate(texts)] * 30, "item_id long, text string")
    sizes, made = [], decontam.Windows
    monkeypatch.setattr(decontam, "Windows", lambda ids, texts, width: sizes.append(sum(map(len, texts))) or made(ids, texts, width))
    assert len(list(decontam._blocks(decontam._pieces(bench, 10), 10, 5000))) == len(sizes) > 1
    assert sum(sizes) == sum(len(t) for t in texts) and max(sizes) < 8000
    rows = [(1, texts[3]), (2, "none of it")]
    got = {r.doc_id: r.n_items for r in decontam.hit_digest(decontam.benchmark_hits(docs(spark, rows), bench, block_chars=5000)).collect()}
    assert got == {1: 1, 2: 0}


def test_keep_good_keeps_a_column_of_its_name(spark):
    rows = docs(spark, [(i, words(random.Random(i), 50)) for i in range(12)]).withColumn("_SCORE", F.lit("mine"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    got = quality.keep_good(rows, labels, 0.0)
    assert got.columns == rows.columns and {r["_SCORE"] for r in got.collect()} == {"mine"} and got.count() == 12


def test_clashing_names(spark):
    """Columns that are named like an operator's own come back as they were."""
    names = {
        "target": 1, "cut": 2, "whole": 3, "source_size": 4, "repetitions": 5, "_size": 6, "_draw": 7, "row": 8, "col": 9,
        "spans": 10, "items": 11, "n_words": 12,
    }
    df = docs(spark, [(i, f"w{i} " * (i + 1)) for i in range(20)] + [(90, ""), (91, None)]).withColumns({k: F.lit(v) for k, v in names.items()})
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and {tuple(r[k] for k in names) for r in mixed.collect()} == {tuple(names.values())}
    counts = mixed.groupBy("doc_id").count().collect()
    assert all(r["count"] <= 2 for r in counts) and {90, 91} <= {r.doc_id for r in counts}
    bench = spark.createDataFrame([(1, "w3 w3 w3 w3")], "item_id long, text string")
    clean = decontam.decontaminate(df, bench)
    assert clean.columns == df.columns and {r.doc_id for r in df.collect()} - {r.doc_id for r in clean.collect()} == {3}
    assert decontam.benchmark_hits(df, bench).where("size(items) > 0").count() == 1
    good = quality.keep_good(df, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    assert good.columns == df.columns
    assert tokens.read_index(tokens.write_ids(df, tokenizer_path())).count() == 22 and katz.katz_scores(df).count() == 22


def read_ogg(data):
    """An independent reader of files with pages that end with a packet or in one: packets and granules of each stream."""
    out, rest, at = {}, {}, 0
    while at < len(data):
        magic, version, flags, granule, serial, _, crc, n = struct.unpack("<4sBBqIIIB", data[at : at + 27])
        assert (magic, version) == (b"OggS", 0)
        sizes, body = data[at + 27 : at + 27 + n], at + 27 + n
        page, reg = data[at : at + 22] + bytes(4) + data[at + 26 : body + sum(sizes)], 0
        for b in page:
            reg ^= b << 24
            for _ in range(8):
                reg = (reg << 1 ^ 0x104C11DB7) if reg >> 31 else reg << 1
        assert reg == crc and (serial in out) != bool(flags & 2)
        out.setdefault(serial, [])
        part = rest.pop(serial, b"")
        assert bool(flags & 1) == bool(part)
        for size in sizes:
            part += data[body : body + size]
            body += size
            if size < 255:
                out[serial].append([part, -1])
                part = b""
        if part:
            rest[serial] = part
        if granule >= 0:
            out[serial][-1][1] = granule
        at = body
    assert not rest
    return out


def test_media_by_another_reader(spark):
    rows = [(1, None), (2, "short é"), (3, "word " * 2000), (4, "x" * 70_000)]
    df = docs(spark, rows)
    media = {r.doc_id: bytes(r.media) for r in ogg.text_to_media(df).collect()}
    got = {r.doc_id: r for r in ogg.media_features(ogg.text_to_media(df)).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        p = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        streams = read_ogg(media[i])
        (head, *packets), peaks = streams[1], [x for x, _ in streams[2][1:]]
        assert b"".join(x for x, _ in packets) == p and struct.unpack("<IQ", head[0][-12:]) == (8000, len(p))
        ends = np.cumsum([len(x) for x, _ in packets]).tolist()
        marks = [(e, g) for e, (_, g) in zip(ends, packets, strict=True) if g >= 0]
        assert all(e == g for e, g in marks) and marks[-1][1] == len(p)
        crossings = sum((a >= 128) != (b >= 128) for a, b in zip(p, p[1:], strict=False))
        want = f"streams=2 packets={len(packets)} marks={len(marks)} gap=0 ms={len(p) // 8} mid={ends[len(ends) // 2] // 8} sum={sum(p)} peak={max(map(max, peaks))} crossings={crossings}"
        r = got[i]
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(media[i]), hashlib.sha256(media[i]).hexdigest(), want)


def test_pieces_whose_sums_meet():
    """Two pieces that no sum of powers modulo 2**64 tells apart get their own ids."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    texts = [" x" + "".join("ab"[b] for b in bits), " x" + "".join("ba"[b] for b in bits)]
    raw = "".join(texts).encode()
    ids, off = tokens.Encoder(tokenizer_path()).encode(np.frombuffer(raw, np.uint8), np.array([0, len(texts[0]), len(raw)]))
    for i, t in enumerate(texts):
        assert ids[off[i] : off[i + 1]].tolist() == tok.encode(t, add_special_tokens=False).ids


def test_statistics_by_plain_python(spark):
    texts = ["", "One two, THREE! 4 |x| <b>\n\nline; é É ß\nline", "  spaces  ", "a" * 5000, "x y " * 300, "100% #1 http://a.b/c?d=e&f"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    got = {r.i: r for r in df.select("i", *[c.alias(k) for k, c in quality.statistics(df.text).items()]).collect()}
    for i, t in enumerate(texts):
        w, n = re.findall(r"[^ \t\n\x0b\x0c\r]+", t), max(len(t), 1)
        per = lambda chars: sum(c in chars for c in t) / n  # noqa: B023, E731
        want = {
            "log_chars": math.log1p(len(t)), "digits": per("0123456789"), "exclaim": per("!?"), "bars": per("|"),
            "symbols": per("#$%&*@^~<>{}[]\\=+_/"), "upper": sum(c.isupper() for c in t) / n,
            "lines": (t.count("\n") + 1) / max(len(w), 1), "word_length": min(len(t) / max(len(w), 1), 1000.0),
            "stops": per(".,;") * n / max(len(w), 1),
        }
        for k, v in want.items():
            assert got[i][k] == pytest.approx(v), (i, k)
