"""URL filters: each URL becomes host-suffix and path-prefix expressions, which meet the rules on short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm import graph

#: A rule's host has so many labels at most (a host name has 253 characters) and its path so many code points.
MOST_LABELS, MOST_PATH = 127, 2048
#: Hex digits of a digest that the join compares: four bytes. What meets there is confirmed by the whole digest.
PREFIX = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z in lower case; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(expression: Column) -> Column:
    return F.sha2(F.encode(expression, "utf-8"), 256)


def compile_rules(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) by digest: labels and size of their expression, rule (host and path) and verdict.

    Hosts are compared in lower case (A-Z). Rows with a null, another verdict than allow or block, or a path that is
    neither empty nor begins with / fit no URL and go; an expression that is both allowed and blocked is blocked. A host
    of more than 127 labels or a path of more than 2,048 code points is refused."""
    host = F.translate("host", _UPPER, _LOWER)
    kept = rules.where("verdict in ('allow', 'block') and host is not null and (path = '' or startswith(path, '/'))")
    kept = kept.select(host.alias("host"), "path", "verdict").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rule = F.concat("host", "path")
    labels, size = F.size(F.split("host", r"\.")), F.length("path")
    out = kept.select(_digest(rule).alias("digest"), labels.alias("labels"), size.alias("size"), rule.alias("rule"), "verdict")
    most = out.agg(F.max("labels"), F.max("size")).first()
    if (most[0] or 0) > MOST_LABELS or (most[1] or 0) > MOST_PATH:
        raise ValueError(f"a rule's host has up to {MOST_LABELS} labels and its path up to {MOST_PATH} characters")
    return out


def expressions(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """Digests (array<string>) of a URL's expressions of the shapes (labels of the host, length of the path) that it has."""
    each = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(k).alias("k")) for n, k in shapes])
    parts = F.split(host, r"\.")
    fits = F.filter(each, lambda s: (s["n"] <= F.size(parts)) & (s["k"] <= F.length(path)))
    suffix = lambda s: F.array_join(F.slice(parts, F.size(parts) - s["n"] + 1, s["n"]), ".")
    return F.transform(fits, lambda s: _digest(F.concat(suffix(s), F.substring(path, F.lit(1), s["k"]))))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, url, host, path, rule and verdict of every row of pages (page_id, url; other columns are not read).

    rules: host, path, verdict (allow or block). A rule fits its host and all of that host's subdomains where the URL's path
    begins with the rule's; of several the longest wins, of equally long ones that of the longer host. Where none fits, rule
    is null and the verdict is the default.

    A URL is expanded only to the shapes (labels, path length) that rules have: at most 127 x 2,049 pairs of numbers, all
    that comes to the driver. Expressions meet rules on the first four bytes of their digests, rules being broadcast
    only up to a counted number of rows (else a shuffle join, whose hot keys Spark splits); only what meets is shuffled, the
    best rule of a URL by a partial aggregate first, so that neither a host nor a URL that many rows share goes to one task whole.

    Null URLs, and those without ://, have empty host and path and fit no rule but one of both empty. Null page_ids, repeated
    rows and very long URLs are judged like others; empty pages give no rows, empty rules the default throughout."""
    if default not in ("allow", "block"):
        raise ValueError("the default verdict is allow or block")
    url = F.col("url")
    given = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    compiled = graph.cut(compile_rules(rules))
    shapes = sorted((r[0], r[1]) for r in compiled.select("labels", "size").distinct().collect())
    if not shapes:
        return given.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    place = F.struct("host", "path").alias("place")
    met = given.select(place, F.explode(expressions(F.col("host"), F.col("path"), shapes)).alias("digest"))
    met = met.select("place", "digest", F.substring("digest", 1, PREFIX).alias("key"))
    listed = compiled.select(F.substring("digest", 1, PREFIX).alias("key"), F.col("digest").alias("whole"), "labels", "size", "rule", "verdict")
    hits = met.join(graph.small(listed), "key").where("digest = whole")
    order = F.struct((F.length("rule")).alias("length"), "labels", "rule", "verdict")
    best = hits.groupBy("place").agg(F.max(order).alias("best"))
    judged = given.withColumn("place", place).join(best, "place", "left")
    verdict = F.coalesce("best.verdict", F.lit(default))
    return judged.select("page_id", "url", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))


def keep_allowed(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Rows of pages whose URL is allowed, with all their columns; repeated rows stay as often as they are there."""
    name = graph.unused(pages, "_url")
    blocked = judge_urls(pages.select(F.lit(0).alias("page_id"), "url").distinct(), rules, default).where("verdict = 'block'")
    return pages.join(blocked.select(F.col("url").alias(name)), F.col("url").eqNullSafe(F.col(name)), "left_anti")
