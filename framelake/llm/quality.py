"""Quality classifier: a sparse rule ensemble over text statistics.

Small boosted trees propose conjunctive rules (the paths to all their nodes), an L1-penalised logistic regression keeps few
of them, and the kept rules become one Spark column expression. Statistics and scores are column expressions over whole
texts; only a bounded sample of labelled statistics comes to the driver to fit on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm import graph

#: Labelled rows that are fitted on, at most about so many (drawn by hash, whatever the number of labels).
SAMPLE_ROWS = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text, null as empty; shares are of its characters or words, 0 for an empty text."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))
    words = F.coalesce(F.regexp_count(t, F.lit(WORD)), F.lit(0))
    per_char = lambda pattern: F.regexp_count(t, F.lit(pattern)) / n
    per_word = lambda x: x / F.greatest(words, F.lit(1))
    return {
        "log_chars": F.log1p(F.length(t).cast("double")),
        "upper": per_char(r"\p{Lu}"),
        "digits": per_char("[0-9]"),
        "exclaim": per_char("[!?]"),
        "bars": per_char(r"[|]"),
        "symbols": per_char(r"[#$%&*@^~<>{}\[\]\\=+_/]"),
        "lines": per_word(F.regexp_count(t, F.lit("\n")) + 1),
        "word_length": F.least(F.length(t) / F.greatest(words, F.lit(1)), F.lit(1000.0)),
        "stops": per_word(F.regexp_count(t, F.lit(r"[.,;]"))),
        "distinct": per_word(F.size(F.array_distinct(F.split(t, r"[\x20\x09-\x0D]+")))),
        "repeats": per_word(F.regexp_count(t, F.lit(r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]+) (?=\1(?![^\x20\x09-\x0D]))"))),
    }


FEATURES = ["log_chars", "upper", "digits", "exclaim", "bars", "symbols", "lines", "word_length", "stops", "distinct", "repeats"]

#: A rule: (feature, below, threshold) conditions that all hold; below: value <= threshold, else value > threshold.
Rule = tuple[tuple[int, bool, float], ...]


@dataclass(frozen=True)
class RuleModel:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    intercept: float

    def matrix(self, x: np.ndarray) -> np.ndarray:
        return rule_matrix(x, self.rules)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.intercept + self.matrix(x) @ np.array(self.weights))))

    def column(self, stats: dict[str, Column]) -> Column:
        """The score as a column expression."""
        total = F.lit(float(self.intercept))
        for rule, w in zip(self.rules, self.weights, strict=True):
            hold = F.lit(True)
            for f, below, at in rule:
                x = stats[FEATURES[f]]
                hold = hold & ((x <= F.lit(float(at))) if below else (x > F.lit(float(at))))
            total = total + F.when(hold, F.lit(float(w))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def rule_matrix(x: np.ndarray, rules) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for j, rule in enumerate(rules):
        for f, below, at in rule:
            out[:, j] *= (x[:, f] <= at) if below else (x[:, f] > at)
    return out


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, bins: int = 48, rate: float = 0.3, least: int = 5) -> list[Rule]:
    """Paths of gradient-boosted trees: each tree fits the gradient of the logistic loss by the best splits of a histogram."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    p0 = min(max(y.mean(), 1e-3), 1 - 1e-3)
    raw, found = np.full(len(y), np.log(p0 / (1 - p0))), {}

    def grow(rows: np.ndarray, path: Rule, left: int):
        g, h = grad[rows], hess[rows]
        if path:
            found[tuple(sorted(path))] = True
        best = None
        if left and len(rows) >= 2 * least:
            total_g, total_h = g.sum(), h.sum()
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                b = binned[rows, f]
                cg, ch = np.cumsum(np.bincount(b, g, len(c) + 1))[:-1], np.cumsum(np.bincount(b, h, len(c) + 1))[:-1]
                cn = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
                gain = cg**2 / (ch + 1) + (total_g - cg) ** 2 / (total_h - ch + 1)
                gain[(cn < least) | (len(rows) - cn < least)] = -1
                k = int(gain.argmax())
                if gain[k] > total_g**2 / (total_h + 1) + 1e-6 and (best is None or gain[k] > best[0]):
                    best = (gain[k], f, k)
        if best is None:
            raw[rows] += rate * g.sum() / (h.sum() + 1)
            return
        _, f, k = best
        go = binned[rows, f] <= k
        at = float(cuts[f][k])
        grow(rows[go], (*path, (f, True, at)), left - 1)
        grow(rows[~go], (*path, (f, False, at)), left - 1)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = y - p, p * (1 - p)
        grow(np.arange(len(y)), (), depth)
    return list(found)


def lasso_logistic(m: np.ndarray, y: np.ndarray, penalty: float = 2e-3, rounds: int = 400) -> tuple[np.ndarray, float]:
    """L1-penalised logistic weights by accelerated proximal gradient; the intercept is not penalised."""
    n, k = m.shape
    mean = m.mean(axis=0)
    scale = np.maximum(m.std(axis=0), 0.02)
    z = (m - mean) / scale
    step = 4 / (np.linalg.norm(z, 2) ** 2 / n + 1) if k else 1.0
    p0 = min(max(y.mean(), 1e-3), 1 - 1e-3)
    w, b = np.zeros(k), float(np.log(p0 / (1 - p0)))
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-(z @ vw + vb))) - y
        nw, nb = vw - step * (z.T @ r) / n, vb - step * r.mean()
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / t2 * (nw - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = nw, nb, t2
    return w / scale, float(b - (w / scale * mean).sum())


def fit(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """A rule model of labelled statistics; without both labels it is a constant."""
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return RuleModel((), (), float(np.log(p / (1 - p))))
    rules = tree_rules(x, y)
    w, b = lasso_logistic(rule_matrix(x, rules), y)
    keep = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleModel(tuple(rules[i] for i in keep), tuple(float(w[i]) for i in keep), b)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from: crc32 of the id's digits is a multiple of 5 (and rows without id)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> RuleModel:
    """Fit on rows of docs with a quality label that are not held out, about `sample_rows` at most, drawn by hash of doc_id.

    A doc_id counts once for each label it has, however many rows of docs or labels repeat it; of its different texts the
    one with the least statistics is taken. So what comes to the driver is bounded by `sample_rows` alone.
    """
    usable = labels.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"),
    ).where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id"))).distinct()
    n = usable.count()
    if n > sample_rows:
        usable = usable.where(F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * sample_rows / n))
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(usable), "doc_id")
    stats = F.struct(*[c.cast("double").alias(k) for k, c in statistics(F.col("text")).items()])
    rows = joined.groupBy("doc_id", "quality").agg(F.min(stats).alias("stats")).select("doc_id", "quality", "stats.*").toPandas()
    rows = rows.sort_values(list(rows.columns), kind="stable")
    return fit(rows[FEATURES].to_numpy(float), rows["quality"].to_numpy(float))


def with_score(docs: DataFrame, model: RuleModel, name: str = "score") -> DataFrame:
    """docs with the model's score of every whole text (null and empty texts too). No row moves."""
    used = sorted({FEATURES[f] for rule in model.rules for f, _, _ in rule}) or FEATURES[:1]
    stats = statistics(F.col("text").cast("string"))
    # a lambda binds the statistics once a row, wherever the optimizer moves the score (a pushed filter would repeat them)
    held = F.array(F.struct(*[stats[k].cast("double").alias(k) for k in used]))
    score = F.element_at(F.transform(held, lambda s: model.column({k: s[k] for k in used})), 1)
    return docs.withColumn(name, score)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: better) and predicted (1 if score >= threshold) of every row of docs.

    docs: doc_id, text; labels: doc_id, quality (0 or 1; other values and nulls are not used); others are ignored. Scores
    depend on the text alone, so repeated texts score alike; without usable labels all rows have one score.
    """
    out = with_score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), learn(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs (all columns) whose score is at least the threshold."""
    name = graph.unused(docs, "_score")
    return with_score(docs, learn(docs, labels), name).where(F.col(name) >= threshold).select(docs.columns)
