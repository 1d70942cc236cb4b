"""URL filters against plain Python."""

import random

import pytest

from framelake.llm import urls

PAGES = "page_id long, url string, html string, host string, rule string, place string"
RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
    ("b.com", "/e", "block"), ("b.com", "/e", "allow"), ("C.b.com", "/", "block"), ("b.com", "/aa", "allow"), ("", "", "block"),
    ("x.org", "", "block"), ("x.org", "q", "block"), (None, "/", "block"), ("y.org", None, "block"), ("y.org", "/", "other"),
]


def plain(url, rules, default):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:n])
        path = rest[n:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = {}
    for h, p, v in rules:
        if h is None or p is None or v not in ("allow", "block") or p and p[0] != "/":
            continue
        h = h.lower()
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fits[h, p] = max(v, fits.get((h, p), ""))
    if not fits:
        return host, path, None, default
    h, p = max(fits, key=lambda r: (len(r[0] + r[1]), r[0].count(".")))
    return host, path, h + p, fits[h, p]


def pages(spark, given):
    return spark.createDataFrame([(i, u, "h", "z", "z", "z") for i, u in given], PAGES)


@pytest.mark.parametrize("default", ["allow", "block"])
def test_urls(spark, default):
    rng = random.Random(3)
    tails = (".com", ".net", "com", ".b.com", ".x.org", ".y.org")
    paths = ("", "/", "/e", "/en", "/en/7", "/es/", "/aab", "//en/")
    given = []
    for i in range(400):
        head = ".".join(rng.choices(("a", "B", "c", "www", "example"), k=rng.randrange(3)))
        end = rng.choice(("", "?a=/en/", "#/en/"))
        given.append((i, f"http{rng.choice(('', 's'))}://{head}{rng.choice(tails)}{rng.choice(paths)}{end}"))
    given += [
        (900, None), (901, ""), (902, "com/en/"), (903, "://"), (904, "x://y://com/en/"), (905, "a\n://net/es/\n?x"),
        (906, "http://éÉ.COM/É"), (907, "h://" + "a." * 5000 + "com/" + "x" * 90_000), (None, "http://net/es/1"),
        (908, "file:///etc"), (909, "http://a..com/"),
    ]
    given += given[:9]
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = sorted((tuple(r) for r in urls.judge_urls(pages(spark, given), rules, default).collect()), key=repr)
    assert got == sorted(((i, u, *plain(u, RULES, default)) for i, u in given), key=repr)
    kept = urls.keep_allowed(pages(spark, given), rules, default)
    assert kept.columns == pages(spark, given).columns
    assert sorted(((r.page_id, r.url) for r in kept.collect()), key=repr) == sorted(
        ((i, u) for i, u in given if plain(u, RULES, default)[3] == "allow"), key=repr,
    )


def test_urls_of_empty_tables(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert urls.judge_urls(pages(spark, []), rules).count() == 0
    assert [tuple(r)[2:] for r in urls.judge_urls(pages(spark, [(1, "http://com/")]), rules.limit(0)).collect()] == [("com", "/", None, "allow")]
    with pytest.raises(ValueError, match="2048"):
        urls.judge_urls(pages(spark, []), spark.createDataFrame([("com", "/" * 3000, "block")], rules.schema))


def test_rules_whose_short_digests_meet(spark, monkeypatch):
    monkeypatch.setattr(urls, "PREFIX", 1)
    rules = spark.createDataFrame([(f"h{i}.com", "/", "block") for i in range(60)], "host string, path string, verdict string")
    given = [(i, f"http://h{i}.com/") for i in range(120)]
    assert sorted(r.page_id for r in urls.judge_urls(pages(spark, given), rules).where("verdict = 'block'").collect()) == list(range(60))
