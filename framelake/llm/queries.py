"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framelake.llm import decontam, fim, katz, licenses, lines, mixing, ogg, quality, secrets, spelling, tokens, urls
from framelake.llm.jaccard import jaccard_classes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents by distinct 3-word shingles at a Jaccard similarity of 0.9 or more."""
    return jaccard_classes(_table(spark, sf_dir, "documents"), 3, 90, 100).drop("digest")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document words inside occurrences of 10-word windows of benchmark items."""
    return decontam.hit_digest(decontam.benchmark_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices and texts in all documents, by patience alignment with templates."""
    return licenses.license_hits(_table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of 150% of all words by weights 3, 1, 2 takes of each document."""
    return mixing.mixture_table(_table(spark, sf_dir, "documents"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all texts, written in the bit-plane format and read back."""
    return tokens.read_index(tokens.write_ids(_table(spark, sf_dir, "documents"), tokenizer_path()))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents by a sparse rule ensemble."""
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents by fixed patterns and by sliding-window entropy."""
    return secrets.secret_digest(_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents that copy a line before them, equal or within two edits."""
    return lines.line_digest(_table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probabilities of all texts under a Katz backoff model of the training rows."""
    return katz.katz_scores(_table(spark, sf_dir, "documents"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts stored as Ogg samples, read back, with features."""
    return ogg.media_features(ogg.text_to_media(_table(spark, sf_dir, "documents")))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with the commoner word that each is a misspelling of."""
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts cut into prefix, middle and suffix at drawn lines, arranged behind sentinels, and restored."""
    made = fim.restore(fim.fill_in_middle(_table(spark, sf_dir, "documents")), texts=False)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


#: host, path and verdict of the rules that pages are judged by (fixed values).
URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the URLs of all pages by the longest rule that fits."""
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return urls.judge_urls(_table(spark, sf_dir, "pages"), rules).drop("url")


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op")}


LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER_SQL}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM w),
t AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM t a JOIN t b
          ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * c >= 90 * (na + nb - c)),
ends AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM s UNION SELECT r.doc_id, ends.b FROM reach r JOIN ends ON r.other = ends.a)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, r.c AS component_id
FROM s JOIN (SELECT doc_id, min(other) AS c FROM reach GROUP BY 1) r USING (doc_id)
"""


OP2_SQL = rf"""
WITH b AS (SELECT item_id, regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, n, unnest(g) AS g FROM (SELECT item_id, least(len(w), 10) AS n,
        [array_to_string(w[i:i + least(len(w), 10) - 1], ' ') for i in range(1, len(w) - least(len(w), 10) + 2)] AS g FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
grams AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS p, unnest([array_to_string(w[i:i + n - 1], ' ') for i in range(1, len(w) - n + 2)]) AS g
          FROM d CROSS JOIN (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
occ AS (SELECT doc_id, p, grams.n, item_id FROM grams JOIN win ON grams.n = win.n AND grams.g = win.g),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM occ) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occ WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5('mix/' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS draw FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY 1),
o AS (SELECT *, 2.0 * n AS cap, row_number() OVER (ORDER BY CAST(n AS DOUBLE) / w, source NULLS LAST) AS i, sum(n) OVER () * 1.5 AS budget FROM s),
k AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
      sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left FROM o),
level AS (SELECT CAST(budget - capped AS DOUBLE) AS rest, CAST(w_left AS DOUBLE) AS w_left FROM k
          WHERE cap / w > CAST(budget - capped AS DOUBLE) / CAST(w_left AS DOUBLE) ORDER BY i LIMIT 1),
t AS (SELECT source, n, CASE WHEN l.rest IS NULL OR cap <= w * l.rest / l.w_left THEN CAST(cap AS DOUBLE) ELSE w * l.rest / l.w_left END AS target
      FROM k LEFT JOIN level l ON true),
e AS (SELECT *, CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END AS whole FROM t),
u AS (SELECT d.*, e.n, e.target, e.whole, sum(size) OVER (PARTITION BY d.source ORDER BY draw, size ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, n AS source_size, target,
       CAST(size * (whole + CASE WHEN upto - size / 2.0 <= target - whole * n THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM u
"""


def _op6_sql() -> str:
    """The same spans from the gaps between matches; entropies by counting each window anew."""
    plain = {0: secrets.ASSIGN, 1: secrets.ACCESS, 2: "[0-9a-f]+", 3: "[A-Za-z0-9+/_=-]+"}
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    keep = {0: f"length(regexp_extract(m, {quote(secrets.ASSIGN)}, 2)) >= 12", 1: "length(m) >= 18", 2: "length(m) >= 16"}
    allowed = " ".join(f"AND NOT regexp_full_match(m, {quote(p)})" for p in secrets.ALLOWED)
    keep[3] = f"length(m) >= 20 AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') {allowed}"
    bits = "CASE " + " ".join(f"WHEN regexp_full_match(m, {quote(p)}) THEN {b}" for _, p, b in secrets.CLASSES) + " ELSE 99 END"
    found = " UNION ALL ".join(
        f"""SELECT * FROM (SELECT doc_id, {k} AS k, ms[i] AS m, CAST(list_sum([length(x) FOR x IN gaps[1:i]]) + coalesce(list_sum([length(x) FOR x IN ms[1:i - 1]]), 0) AS BIGINT) AS s
        FROM (SELECT doc_id, string_split_regex(t, {quote(p)}) AS gaps, regexp_extract_all(t, {quote(p)}) AS ms FROM d), unnest(range(1, len(ms) + 1)) u(i)) WHERE {keep[k]}"""
        for k, p in plain.items()
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({found}),
base AS (SELECT doc_id, k, s, s + length(m) AS e FROM f WHERE k < 3),
c AS (SELECT doc_id, s, m, {bits} AS bits FROM f WHERE k = 3),
w AS (SELECT doc_id, s, any_value(bits) AS bits, i, log2(20) - sum(n * log2(n)) / 20 AS h FROM (
      SELECT doc_id, s, bits, i, ch, count(*) AS n FROM (SELECT doc_id, s, bits, i, unnest(string_split(substr(m, CAST(i AS INTEGER) + 1, 20), '')) AS ch FROM c, unnest(range(0, length(m) - 19)) u(i)) GROUP BY ALL) GROUP BY doc_id, s, i),
hot AS (SELECT doc_id, 3 AS k, s + min(i) AS s, s + max(i) + 20 AS e FROM w WHERE h >= bits GROUP BY doc_id, w.s),
spans AS (SELECT * FROM base UNION ALL SELECT * FROM hot WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = hot.doc_id AND b.s < hot.e AND hot.s < b.e)),
named AS (SELECT *, (['assign', 'access', 'hex', 'entropy'])[k + 1] || ':' || s || ':' || e AS said FROM spans)
SELECT d.doc_id, count(said) FILTER (k = 0) AS n_assign, count(said) FILTER (k = 1) AS n_access, count(said) FILTER (k = 2) AS n_hex,
       sha256(coalesce(string_agg(said, ',' ORDER BY s, k) FILTER (k < 3), '')) AS base_sha256, coalesce(string_agg(said, ',' ORDER BY s, k), '') AS spans
FROM d LEFT JOIN named USING (doc_id) GROUP BY d.doc_id
"""


#: CRC-32 by a table that is built from its polynomial; near words share a word with one code point less.
OP11_SQL = rf"""
WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
       lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM unnest(range(256)) u(i))),
runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({LOWER_SQL}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
         WHERE length(run) >= 6 GROUP BY 1, 2),
bytes AS (SELECT run, n, flatten([CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c) - 64] END
          FOR c IN string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, '')]) AS b FROM runs),
sums AS (SELECT run, n, xor(list_reduce([4294967295::BIGINT] || b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, tab),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM sums)
      WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
less AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS d FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
near AS (SELECT a.word AS a, b.word AS b FROM less a JOIN less b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
         UNION SELECT less.word, d FROM less JOIN v ON v.word = d UNION SELECT d, less.word FROM less JOIN v ON v.word = d),
best AS (SELECT a, count(*) AS n_near, (list(b ORDER BY n DESC, b))[1] AS b, max(n) AS n FROM near JOIN v ON word = b GROUP BY 1),
f AS (SELECT word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 5 * v.n THEN b END AS form, CASE WHEN best.n >= 5 * v.n THEN best.n END AS form_n FROM v LEFT JOIN best ON a = word),
chain AS (SELECT word, word AS root FROM f UNION SELECT chain.word, form FROM chain JOIN f ON f.word = chain.root WHERE form IS NOT NULL)
SELECT f.word, f.form, root, f.n, f.n_near, f.form_n FROM f JOIN chain USING (word) JOIN f g ON g.word = root AND g.form IS NULL
"""

OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
                  sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT *, CAST(len(u) AS BIGINT) AS n, [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) FOR i IN range(0, 4)] AS x FROM d),
c AS (SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS a, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR x[3] % 100 >= 100 THEN 'plain'
                  WHEN x[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM p
"""

OP13_SQL = rf"""
WITH r(h, p, v) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}),
u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
m AS (SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
      FROM (SELECT DISTINCT host, path FROM u) JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY 1, 2)
SELECT page_id, u.host, u.path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN m ON u.host = m.host AND u.path = m.path
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard_join": OP1_SQL,
        "op2_benchmark_decontamination": OP2_SQL,
        "op4_source_mixing": OP4_SQL,
        "op6_secret_scan": _op6_sql(),
        "op11_spelling_variants": OP11_SQL,
        "op12_fill_in_middle": OP12_SQL,
        "op13_url_filter": OP13_SQL,
    }
