"""Quality classifier: a sparse ensemble of rules.

Trees on text statistics give conjunctions of thresholds, one for each path; a lasso
logistic regression weighs them, and most weights are zero. The rules that remain are
compiled into one Spark column, so scoring is a map of built-in expressions.

The fit takes labelled rows whose crc32(doc_id as text) mod 5 is not 0, at most
``TRAIN_ROWS`` of them, chosen by a hash of the id: that bounds what the driver gets.
Labels, language, source and id are never inputs of a score.

Defined results: null and empty texts have zero statistics and a score as others do. Rows
are scored one by one, repeated ones too. A label that is null or whose document is missing
is not used; with labels of one kind only, or none, the score is their share (0.5 without
any). A null doc_id is never held out and never taught. Columns beside doc_id and text are ignored. An empty table gives an
empty table.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_rules import text_statistics

#: Labelled rows that the fit takes at most.
TRAIN_ROWS = 20_000
TREES, DEPTH, PENALTY, STEPS = 24, 3, 2e-4, 400

_ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))


def features(docs: DataFrame) -> DataFrame:
    """``docs`` with a double column for each feature."""
    stats = text_statistics(docs, more=True)
    chosen = {
        "f_words": F.log1p("n_words"),
        "f_word_length": _ratio("word_chars", "n_words"),
        "f_symbols": _ratio("n_symbols", "word_chars"),
        "f_stop_words": _ratio("n_stop_words", "n_words"),
        "f_repeats": _ratio("n_repeat_words", "n_words"),
        "f_distinct": _ratio("n_distinct_words", "n_words"),
        "f_dup_lines": _ratio("n_dup_lines", "n_lines"),
        "f_line_words": _ratio("n_words", "n_lines"),
        "f_upper": _ratio("n_upper", "word_chars"),
        "f_digits": _ratio("n_digits", "word_chars"),
        "f_marks": _ratio("n_marks", "word_chars"),
        "f_stops": _ratio("n_stops", "n_words"),
    }
    return stats.withColumns({k: v.cast("double") for k, v in chosen.items()})


NAMES = ("f_words", "f_word_length", "f_symbols", "f_stop_words", "f_repeats", "f_distinct", "f_dup_lines", "f_line_words", "f_upper", "f_digits", "f_marks", "f_stops")


class Condition(NamedTuple):
    feature: int
    above: bool  # > threshold, else <=
    threshold: float


class Ensemble(NamedTuple):
    rules: tuple[tuple[Condition, ...], ...]
    weights: tuple[float, ...]
    intercept: float

    def score(self) -> Column:
        """The ensemble as one expression over the feature columns. Terms are added up in pairs: one after another, a few hundred of them would overflow the planner's stack."""
        holds = lambda c: F.col(NAMES[c.feature]) > c.threshold if c.above else F.col(NAMES[c.feature]) <= c.threshold
        terms = [F.when(reduce(lambda a, b: a & b, map(holds, r)), F.lit(w)).otherwise(F.lit(0.0)) for r, w in zip(self.rules, self.weights, strict=True)]
        terms = [F.lit(self.intercept), *terms]
        while len(terms) > 1:
            terms = [reduce(lambda a, b: a + b, terms[k : k + 2]) for k in range(0, len(terms), 2)]
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-terms[0]))


def _split(x: np.ndarray, y: np.ndarray, among: np.ndarray, least: int) -> tuple[float, int, float]:
    """The best gain in squared error over the features ``among``: (gain, feature, threshold)."""
    best = (0.0, -1, 0.0)
    for f in among:
        order = np.argsort(x[:, f], kind="stable")
        v, s = x[order, f], np.cumsum(y[order])
        k = np.arange(1, len(y))
        ok = (v[1:] > v[:-1]) & (k >= least) & (len(y) - k >= least)
        if not ok.any():
            continue
        gain = np.where(ok, s[:-1] ** 2 / k + (s[-1] - s[:-1]) ** 2 / (len(y) - k) - s[-1] ** 2 / len(y), -1)
        at = int(np.argmax(gain))
        if gain[at] > best[0] + 1e-9:
            best = (float(gain[at]), int(f), float((v[at] + v[at + 1]) / 2))
    return best


def _paths(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, path: tuple[Condition, ...] = ()) -> list[tuple[Condition, ...]]:
    """Paths to all nodes below the root of one tree grown on residuals ``y``."""
    if depth == 0 or len(y) < 20:
        return []
    gain, f, t = _split(x, y, rng.permutation(x.shape[1])[: max(4, x.shape[1] // 2)], max(5, len(y) // 200))
    if f < 0:
        return []
    out = []
    for above in (False, True):
        here = (x[:, f] > t) == above
        mine = (*path, Condition(f, above, t))
        out += [mine, *_paths(x[here], y[here], rng, depth - 1, mine)]
    return out


def _matrix(x: np.ndarray, rules: list[tuple[Condition, ...]]) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for j, rule in enumerate(rules):
        for c in rule:
            out[:, j] *= (x[:, c.feature] > c.threshold) == c.above
    return out


def fit(x: np.ndarray, y: np.ndarray, seed: int = 3) -> Ensemble:
    """Rules from boosted trees on half samples, then lasso logistic weights by accelerated proximal steps."""
    if len(y) == 0 or y.min() == y.max():
        share = 0.5 if not len(y) else float(y[0])
        return Ensemble((), (), float(np.log((share * 98 + 1) / (99 - share * 98))))
    rng, rules = np.random.default_rng(seed), []
    margin = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(TREES):
        rows = rng.permutation(len(y))[: max(50, len(y) // 2)]
        residual = y - 1 / (1 + np.exp(-margin))
        paths = _paths(x[rows], residual[rows], rng, DEPTH)
        rules += paths
        for p in paths:  # a small step toward each node's mean residual
            inside = _matrix(x, [p])[:, 0] > 0
            if inside.any():
                margin[inside] += 0.3 * residual[inside].mean()
    rules = list(dict.fromkeys(rules))
    m = _matrix(x, rules)
    mean, scale = m.mean(axis=0), np.maximum(m.std(axis=0), 0.05)
    z = (m - mean) / scale
    bound = 0.25 * (np.square(z).sum(axis=1).mean() + 1)  # of the curvature
    w, v, b, c, t = np.zeros(z.shape[1]), np.zeros(z.shape[1]), 0.0, 0.0, 1.0
    b = c = float(np.log(y.mean() / (1 - y.mean())))
    for _ in range(STEPS):
        r = 1 / (1 + np.exp(-(z @ v + c))) - y
        new = v - (z.T @ r) / len(y) / bound
        new = np.sign(new) * np.maximum(np.abs(new) - PENALTY / bound, 0)
        new_b = c - r.mean() / bound
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new, new_b, t_new
    used = np.flatnonzero(np.abs(w) > 1e-6)
    return Ensemble(tuple(rules[j] for j in used), tuple((w[used] / scale[used]).tolist()), float(b - (w * mean / scale).sum()))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Ensemble:
    """An ensemble from the labelled rows that are not held out."""
    known = labels.select(F.col("doc_id").alias("doc_id"), F.col("quality").cast("double").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL")
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(rows)  # at most TRAIN_ROWS pairs of numbers
    sample = features(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")).select("doc_id", "y", *NAMES)
    got = sample.toPandas().sort_values(["doc_id", "y", *NAMES])
    return fit(got[list(NAMES)].to_numpy(float), got["y"].to_numpy(float))


def score(docs: DataFrame, ensemble: Ensemble) -> DataFrame:
    """``docs`` with ``score``; all other columns as they are, whatever their names."""
    names = [c for c in docs.columns if c != "score"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("text"))
    return features(rows).withColumn("score", ensemble.score()).select("_row.*", "score")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select(
        "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )
