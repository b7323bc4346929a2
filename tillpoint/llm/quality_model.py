"""Operator 4: quality classifier as a sparse rule ensemble, compiled to Spark column expressions.

Small trees are grown on statistics of a bounded stable sample of labelled documents; every path from a root
to a node becomes a conjunctive rule; lasso logistic regression keeps few of them; the kept rules,
weighted, are one Spark expression over the statistics of any document. No label, lang, source or
doc_id is an input of a score.

Null text counts as empty and is scored; labels of null quality or unknown documents are ignored; without
labels of both kinds the score is the (smoothed) share of label 1, and 1 without any label; null and
repeated doc_ids keep a row each; an empty table gives no rows.
"""
from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillpoint.llm.common import crc_mod, stable_sample, words_column

#: Labelled documents of each class the model is fitted on, trees, their depth, least documents in a node.
SAMPLE_DOCS, TREES, DEPTH, LEAST = 3000, 30, 3, 10

STATISTICS = ("n_words", "mean_word", "distinct_words", "next_same", "symbols", "uppers", "digits", "marks", "distinct_lines", "words_a_line")


def with_statistics(docs: DataFrame) -> DataFrame:
    """Adds STATISTICS of `text` as doubles. Shares are of words, word characters or lines; 0 for an empty text."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x) != "")
    with_words = docs.withColumn("_words", words_column(F.col("text"))).withColumn("_lines", lines)
    words, n = F.col("_words"), F.size("_words")
    size, n_lines = F.greatest(F.length(text), F.lit(1)), F.greatest(F.size("_lines"), F.lit(1))
    some = F.greatest(n, F.lit(1))
    # a word equal to the one before
    same = F.size(F.filter(words, lambda w, i: (i > 0) & (w == F.get(words, i - 1))))
    stats = {
        "n_words": n, "mean_word": F.length(F.array_join(words, "")) / some, "distinct_words": F.size(F.array_distinct(words)) / some,
        "next_same": same / some, "symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>{}\[\]=_~^@\\]")) / size,
        "uppers": F.regexp_count(text, F.lit(r"\p{Lu}")) / size, "digits": F.regexp_count(text, F.lit(r"[0-9]")) / size,
        "marks": F.regexp_count(text, F.lit(r"[!?;:]")) / size, "distinct_lines": F.size(F.array_distinct("_lines")) / n_lines,
        "words_a_line": n / n_lines,
    }
    return with_words.withColumns({k: v.cast("double") for k, v in stats.items()}).drop("_words", "_lines")


@dataclass(frozen=True)
class Rule:
    """All of `terms` hold: (statistic, True for `<=` or False for `>`, threshold)."""
    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, below, at in self.terms:
            out &= (x[:, f] <= at) == below
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for f, below, at in self.terms:
            c = F.col(STATISTICS[f])
            out = out & (c <= at if below else c > at)
        return out


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, features: np.ndarray, depth: int, least: int, path: tuple = ()) -> list[Rule]:
    """Rules of all nodes under this one: best weighted-Gini split at 31 quantiles of the chosen statistics."""
    total, good = w.sum(), (w * y).sum()
    if depth == 0 or len(y) < 2 * least or good <= 0 or good >= total:
        return []
    best = None
    for f in features:
        cuts = np.unique(np.quantile(x[:, f], np.linspace(0, 1, 33)[1:-1]))
        values = np.unique(x[:, f])
        after = np.searchsorted(values, cuts, "right")
        cuts = (values[after - 1] + values[np.minimum(after, len(values) - 1)]) / 2  # between two values seen
        below = x[:, f, None] <= cuts[None, :]
        n = below.sum(0)
        t, g = w @ below, (w * y) @ below
        ok = (n >= least) & (len(y) - n >= least)
        if not ok.any():
            continue
        gini = np.where(ok, g * (t - g) / np.maximum(t, 1e-9) + (good - g) * (total - t - good + g) / np.maximum(total - t, 1e-9), np.inf)
        i = int(gini.argmin())
        if best is None or gini[i] < best[0]:
            best = (gini[i], int(f), float(cuts[i]))
    if best is None or best[0] >= good * (total - good) / total * 0.999:
        return []
    _, f, cut = best
    side = x[:, f] <= cut
    out = []
    for part, below in ((side, True), (~side, False)):
        terms = (*path, (f, below, cut))
        out += [Rule(tighten(terms)), *grow(x[part], y[part], w[part], features, depth - 1, least, terms)]
    return out


def tighten(terms: tuple) -> tuple:
    """The same conjunction with one bound a side and statistic."""
    bound: dict = {}
    for f, below, at in terms:
        old = bound.get((f, below))
        bound[f, below] = at if old is None else (min if below else max)(old, at)
    return tuple(sorted((f, below, at) for (f, below), at in bound.items()))


def lasso_logistic(r: np.ndarray, y: np.ndarray, w: np.ndarray, l1: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """(bias, weights) of weighted logistic loss + l1 by accelerated proximal gradient."""
    w = w / w.sum()
    p = min(max(float(w @ y), 1e-4), 1 - 1e-4)
    bias, beta = math.log(p / (1 - p)), np.zeros(r.shape[1])
    rate = 1 / (0.25 * max(np.linalg.norm(r * np.sqrt(w)[:, None], 2) ** 2 + 1, 1e-9))
    b0, v, t = bias, beta.copy(), 1.0
    for _ in range(steps):
        e = w * (1 / (1 + np.exp(-(b0 + r @ v))) - y)
        step = v - rate * (r.T @ e)
        new, new_bias = np.sign(step) * np.maximum(np.abs(step) - rate * l1, 0), b0 - rate * e.sum()
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, b0 = new + (t - 1) / t_new * (new - beta), new_bias + (t - 1) / t_new * (new_bias - bias)
        beta, bias, t = new, new_bias, t_new
    return bias, beta


@dataclass
class RuleEnsemble:
    bias: float
    rules: list[tuple[float, Rule]]

    def column(self) -> Column:
        """Score in 0..1 over the columns of `with_statistics`."""
        z = F.lit(self.bias)
        for weight, rule in self.rules:
            z = z + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for weight, rule in self.rules:
            z += weight * rule.holds(x)
        return 1 / (1 + np.exp(-z))


def fit_rules(x: np.ndarray, y: np.ndarray, w: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 11) -> RuleEnsemble:
    """Trees on random halves of rows and statistics, all rules, then the lasso strength that does best on a fifth kept out."""
    rng = np.random.default_rng(seed)
    rules = []
    for _ in range(trees):
        rows = rng.choice(len(y), max(2, len(y) // 2), replace=False)
        features = np.sort(rng.choice(x.shape[1], max(2, x.shape[1] // 2), replace=False))
        rules += grow(x[rows], y[rows], w[rows], features, depth, LEAST)
    seen: dict = {}
    for rule in rules:  # rules that hold for the same rows are one
        seen.setdefault(rule.holds(x).tobytes(), rule)
    rules = [r for r in seen.values() if 0 < r.holds(x).mean() < 1]
    p = float((w * y).sum() / w.sum())
    if not rules:
        return RuleEnsemble(math.log(p / (1 - p)), [])
    r = np.column_stack([rule.holds(x) for rule in rules]).astype(float)
    held = rng.random(len(y)) < 0.2
    best = None
    for l1 in (1e-2, 3e-3, 1e-3, 3e-4, 1e-4):
        bias, beta = lasso_logistic(r[~held], y[~held], w[~held], l1)
        q = np.clip(1 / (1 + np.exp(-(bias + r[held] @ beta))), 1e-6, 1 - 1e-6)
        loss = -(w[held] * (y[held] * np.log(q) + (1 - y[held]) * np.log(1 - q))).sum() if held.any() else l1
        if best is None or loss < best[0]:
            best = (loss, l1)
    bias, beta = lasso_logistic(r, y, w, best[1], 1000)
    return RuleEnsemble(float(bias), [(float(b), rule) for b, rule in zip(beta, rules) if abs(b) > 1e-6])


def train_quality_model(docs: DataFrame, labels: DataFrame, usable: Callable[[], Column] = lambda: F.lit(True), sample_docs: int = SAMPLE_DOCS) -> RuleEnsemble:
    """Fitted on at most about `sample_docs` labelled documents of each class, weighted back to the classes' shares."""
    marked = labels.select("doc_id", "quality").where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & usable())
    totals = {r.quality: r.n for r in marked.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    share = (totals.get(1, 0) + 1) / (sum(totals.values()) + 1)
    if len(totals) < 2:
        return RuleEnsemble(40.0 if share >= 1 else math.log(share / (1 - share)), [])
    chosen = stable_sample(marked, F.col("doc_id"), sample_docs, by="quality")
    # the sample has a bounded number of rows of 12 bytes
    rows = with_statistics(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")).select("doc_id", "quality", *STATISTICS).collect()
    rows.sort(key=tuple)
    y = np.array([r.quality for r in rows], float)
    if len(set(y)) < 2:
        return RuleEnsemble(math.log(share / (1 - share)) if share < 1 else 40.0, [])
    x = np.array([r[2:] for r in rows], float)
    w = np.where(y == 1, totals[1] / max((y == 1).sum(), 1), totals[0] / max((y == 0).sum(), 1))
    return fit_rules(x, y, w)


def score_quality(docs: DataFrame, model: RuleEnsemble, threshold: float = 0.7) -> DataFrame:
    """The documents with score and predicted, all other columns kept."""
    keep = docs.columns
    plain = docs.select(F.col("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))  # so that no column clashes
    scored = with_statistics(plain).withColumn("score", model.column())
    return scored.select(F.col("_row").alias("row"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")).select(
        *(F.col("row").getField(c).alias(c) for c in keep if c not in ("score", "predicted")), "score", "predicted")


def held_out() -> Column:
    return crc_mod("doc_id", 4) == 2
