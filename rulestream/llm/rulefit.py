"""Quality classifier: a sparse ensemble of rules over statistics of the text.

Statistics are Spark columns. Shallow boosted trees are grown on labelled rows; every path from a
root to a node is a rule, a conjunction of comparisons. Logistic regression with an L1 penalty
gives most rules no weight, and the rest are compiled to one Spark column expression, so scoring
stays in the JVM and needs no shuffle.

Trees and weights are fitted on at most about ``per_class`` labelled rows of each class (their
statistics, not their texts, come to the driver), each weighed by the rows of its class that it
stands for, so scores don't depend on how much was left out; all documents and whole texts are scored.

Defined results: a null text counts as an empty one, and an empty text is scored like any other,
by statistics of zero. Without labelled rows of both classes the score is the share of good rows
among them, 0.5 if there are none. Repeated rows get equal results. An empty table gives an empty
table. Input columns pass through; ``score`` and ``predicted`` replace columns of the same name.
Bytes that aren't UTF-8 count as U+FFFD.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulestream.llm.common import WS_CHARS, free, labelled_sample, valid, without

WS_RE = r"[\x20\x09-\x0D]+"
STATS = (
    "words", "mean_word", "long_words", "short_words", "distinct_words", "symbols", "marks", "upper", "digits",
    "lines", "line_words", "dup_lines", "alone", "top_word_share", "ends_marked",
)


def prefix_for(docs: DataFrame) -> str:
    """A prefix that no column of ``docs`` has."""
    prefix = "_q_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    return prefix


def with_statistics(docs: DataFrame, prefix: str = "_q_") -> DataFrame:
    """``docs`` with the statistics, as doubles, under ``prefix``."""
    own = free(docs, "_v", "_t", "_l", "_n", "_c", "_d", "_ln", "_len")
    v, t, ls, nw, nc, d, ln, lens = own
    text = F.col(v)
    n = lambda c: c.cast("double")
    without_chars = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    trimmed = F.btrim(text, F.lit(WS_CHARS))
    # a column of its own, so that the bytes are checked once and not again for each statistic
    step = docs.withColumn(v, F.coalesce(valid(), F.lit("")))
    step = step.withColumn(t, F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WS_RE, -1)))
    step = step.withColumn(ls, F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(WS_CHARS)) != ""))
    step = step.withColumns({nw: n(F.size(t)), nc: n(F.length(text)), d: F.array_distinct(t), ln: n(F.size(ls)), lens: F.transform(t, lambda w: F.length(w))})
    some, chars, lines = F.greatest(nw, F.lit(1.0)), F.greatest(nc, F.lit(1.0)), F.greatest(ln, F.lit(1.0))
    made = {
        "words": F.log1p(nw),
        "mean_word": n(F.aggregate(lens, F.lit(0).cast("bigint"), lambda a, x: a + x)) / some,
        "long_words": n(F.size(F.filter(lens, lambda x: x >= 8))) / some,
        "short_words": n(F.size(F.filter(lens, lambda x: x <= 3))) / some,
        "distinct_words": n(F.size(d)) / some,
        "symbols": n(without_chars("#*$%&|<>@^~{}[]\\+=_")) / chars,
        "marks": n(without_chars("!?.,;:")) / chars,
        "upper": n(F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", ""))) / chars,
        "digits": n(without_chars("0123456789")) / chars,
        "lines": F.log1p(ln),
        "line_words": F.col(nw) / lines,
        "dup_lines": (F.col(ln) - n(F.size(F.array_distinct(ls)))) / lines,
        "alone": n(F.size(F.filter(t, lambda w: F.length(w) == 1))) / some,
        "top_word_share": (F.col(nw) - n(F.size(d))) / F.greatest(F.sqrt(nw), F.lit(1.0)),
        "ends_marked": n(F.size(F.filter(ls, lambda x: F.btrim(x, F.lit(WS_CHARS)).rlike(r"[.!?]$")))) / lines,
    }
    return step.withColumns({prefix + k: v for k, v in made.items()}).drop(*own)


Condition = tuple[int, bool, float]  # feature, at most (else above), value


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, cuts: list[np.ndarray], depth: int, path: tuple[Condition, ...], least: int) -> tuple[list[tuple[Condition, ...]], np.ndarray]:
    """The paths below a node, and the node's step for each row."""
    value = np.full(len(x), grad.sum() / (hess.sum() + 1.0))
    if depth == 0 or len(x) < 2 * least:
        return [], value
    best, total_g, total_h = (1e-3, None, None), grad.sum(), hess.sum()
    for f, edges in enumerate(cuts):
        if not len(edges):
            continue
        bins = np.searchsorted(edges, x[:, f], side="left")
        g, h, c = (np.cumsum(np.bincount(bins, v, len(edges) + 1))[:-1] for v in (grad, hess, np.ones(len(x))))
        gain = g**2 / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
        gain[(c < least) | (len(x) - c < least)] = -1
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (float(gain[k]), f, float(edges[k]))
    if best[1] is None:
        return [], value
    low, paths = x[:, best[1]] <= best[2], []
    for side in (True, False):
        rows = low == side
        here = (*path, (best[1], side, best[2]))
        below, value[rows] = _grow(x[rows], grad[rows], hess[rows], cuts, depth - 1, here, least)
        paths += [here, *below]
    return paths, value


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.4, bins: int = 48, weight: np.ndarray | float = 1.0) -> list[tuple[Condition, ...]]:
    """The distinct paths of boosted trees."""
    cuts = [np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1])) for col in x.T]
    margin, rules = np.zeros(len(x)), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        paths, step = _grow(x, weight * (y - p), weight * p * (1 - p), cuts, depth, (), max(4, len(x) // 400))
        margin += rate * 4 * np.clip(step, -1, 1)
        for path in paths:
            rules[_tidy(path)] = None
    return list(rules)


def _tidy(path: tuple[Condition, ...]) -> tuple[Condition, ...]:
    """A path with the tightest of its comparisons of each feature and side."""
    tight: dict[tuple[int, bool], float] = {}
    for f, low, v in path:
        old = tight.get((f, low))
        tight[f, low] = v if old is None else min(old, v) if low else max(old, v)
    return tuple(sorted((f, low, v) for (f, low), v in tight.items()))


def fires(rule: tuple[Condition, ...], x: np.ndarray) -> np.ndarray:
    return reduce(and_, [(x[:, f] <= v) == low for f, low, v in rule])


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 600, weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and constant by accelerated proximal gradient; the constant isn't penalised. ``weight`` of the rows has a mean of 1."""
    weight = np.ones(len(z)) if weight is None else weight
    mean, share = (weight[:, None] * z).mean(0), float((weight * y).mean())
    scale = np.sqrt((weight[:, None] * (z - mean) ** 2).mean(0)) + 1e-6
    zs, center = z / scale, mean / scale
    zs = zs - center
    w, b = np.zeros(z.shape[1]), float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    v, vb, t = w, b, 1.0
    size = 4 * len(z) / max(np.linalg.norm(np.sqrt(weight)[:, None] * zs, 2) ** 2, 1e-9) if zs.size else 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(zs @ v + vb, -50, 50)))
        off = weight * (y - p)
        raw = v + size * (zs.T @ off) / len(z)
        new, nb = np.sign(raw) * np.maximum(np.abs(raw) - size * penalty, 0), vb + 4 * float(off.mean())
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, vb = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    return w / scale, b - float(w @ center)


@dataclass(frozen=True)
class Ensemble:
    rules: tuple[tuple[tuple[Condition, ...], float], ...]
    constant: float

    def column(self, prefix: str = "_q_") -> Column:
        """The score as a Spark expression over the statistics."""
        total = F.lit(self.constant)
        for rule, weight in self.rules:
            tests = [F.col(prefix + STATS[f]) <= v if low else F.col(prefix + STATS[f]) > v for f, low, v in rule]
            total = total + F.when(reduce(and_, tests), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.constant)
        for rule, weight in self.rules:
            total += weight * fires(rule, x)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 2e-3, weight: np.ndarray | None = None) -> Ensemble:
    """An ensemble from statistics and labels; ``weight`` tells how many rows each row stands for, one if not given."""
    if len(y) == 0 or y.min() == y.max():
        share = min(max(float(y.mean()) if len(y) else 0.5, 1e-6), 1 - 1e-6)
        return Ensemble((), float(np.log(share / (1 - share))))
    weight = np.ones(len(y)) if weight is None else weight / weight.mean()
    rules = grow_rules(x, y, weight=weight)
    z = np.column_stack([fires(r, x) for r in rules]).astype(float) if rules else np.zeros((len(x), 0))
    w, b = lasso_logistic(z, y, penalty, weight=weight)
    return Ensemble(tuple((r, float(v)) for r, v in zip(rules, w) if abs(v) > 1e-6), b)


def train(docs: DataFrame, labels: DataFrame, parts: int = 4, part: int = 2, per_class: int = 6000, label: str = "quality") -> Ensemble:
    """An ensemble from the labelled documents that aren't held out; a sampled row weighs as many of its class as it stands for."""
    sample = with_statistics(labelled_sample(docs, labels, label, parts, part, per_class).select("doc_id", "label", "weight", "text"))
    rows = sorted(sample.select("doc_id", "label", "weight", *(f"_q_{k}" for k in STATS)).collect(), key=lambda r: tuple(map(str, r)))
    x, y = np.array([list(r[3:]) for r in rows], float).reshape(-1, len(STATS)), np.array([float(r[1]) for r in rows])
    return fit(x, y, weight=np.array([r["weight"] for r in rows]))


def score_documents(docs: DataFrame, ensemble: Ensemble, least: float = 0.7) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from a score of ``least``)."""
    docs = without(docs, "score", "predicted")
    prefix = prefix_for(docs)
    stats = with_statistics(docs, prefix)
    return stats.withColumn("score", ensemble.column(prefix)).withColumn("predicted", (F.col("score") >= least).cast("int")).drop(*(prefix + k for k in STATS))
