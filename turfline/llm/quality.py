"""Quality scores by a sparse rule ensemble over text statistics, compiled to Spark columns."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turfline.llm.common import remainder, table, with_columns
from turfline.llm.sample import by_hash

STATISTICS = (
    "log_chars", "log_words", "word_length", "letter_share", "upper_share", "digit_share", "space_share", "mark_share", "symbol_share",
    "distinct_words", "top_word", "words_per_line", "distinct_lines", "capital_words", "symbol_words", "short_words", "sentence_words",
)
#: Most labelled rows the rules are fitted on (the documented bound of the sample).
SAMPLE_ROWS = 8000


@lru_cache(1)
def _classes() -> np.ndarray:
    """Per code point: 0 lower or other letter, 1 upper, 2 digit, 3 white space, 4 sentence mark, 5 symbol."""
    kinds = np.full(0x110000, 5, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            kinds[i] = 1 if c.isupper() else 0
        elif c.isdigit():
            kinds[i] = 2
        elif c.isspace():
            kinds[i] = 3
    kinds[[ord(c) for c in ".,;:?!'\"()-"]] = 4
    return kinds


def statistics(text: str | None) -> list[float]:
    """The numbers of STATISTICS for a whole text; an empty or null text has zeros."""
    if not text:
        return [0.0] * len(STATISTICS)
    n = len(text)
    lower, upper, digits, space, marks, symbols = np.bincount(
        _classes()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)], minlength=6
    ).tolist()
    words = text.split()
    m = max(len(words), 1)
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    capital = symbol = short = 0
    for w, k in seen.items():
        capital += k * (w[0].isupper())
        symbol += k * (not w[-1].isalnum() and w[-1] not in ".,;:?!'\"()-")
        short += k * (len(w) <= 2)
    lines = [x for x in text.split("\n") if x]
    letters = lower + upper
    return [
        np.log1p(n), np.log1p(len(words)), (n - space) / m, letters / n, upper / max(letters, 1), digits / n, space / n, marks / n, symbols / n,
        len(seen) / m, max(seen.values(), default=0) / m, len(words) / max(len(lines), 1), len(set(lines)) / max(len(lines), 1),
        capital / m, symbol / m, short / m, len(words) / (1 + text.count(".") + text.count("!") + text.count("?")),
    ]


@dataclass
class RuleModel:
    """``rules``: conjunctions of (statistic, above, threshold); a score is the logistic of the weights of those that hold."""

    rules: list[tuple] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    intercept: float = 0.0

    def column(self, of) -> Column:
        """The score as a Spark expression; ``of`` gives the column of a statistic."""

        def holds(rule: tuple) -> Column:
            tests = [(of(s) > t) if above else (of(s) <= t) for s, above, t in rule]
            return reduce(lambda a, b: a & b, tests)

        z = F.lit(self.intercept)
        for rule, w in zip(self.rules, self.weights):
            z = z + F.when(holds(rule), F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def _grow(bins: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, path: tuple, out: list, value: np.ndarray) -> None:
    """One tree on binned statistics; ``out`` gets the path to every node, ``value`` the leaf values."""
    if path:
        out.append(path)
    best = (1e-3, None)
    total_g, total_h = g[rows].sum(), h[rows].sum()
    if depth and len(rows) >= 20:
        for j in range(bins.shape[1]):
            gl = np.cumsum(np.bincount(bins[rows, j], g[rows], 64))[:-1]
            hl = np.cumsum(np.bincount(bins[rows, j], h[rows], 64))[:-1]
            nl = np.cumsum(np.bincount(bins[rows, j], minlength=64))[:-1]
            gain = gl**2 / (hl + 1) + (total_g - gl) ** 2 / (total_h - hl + 1) - total_g**2 / (total_h + 1)
            gain[(nl < 5) | (nl > len(rows) - 5)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (j, k))
    if best[1] is None:
        value[rows] = -total_g / (total_h + 1)
        return
    j, k = best[1]
    left = bins[rows, j] <= k
    _grow(bins, g, h, rows[left], depth - 1, (*path, (j, False, k)), out, value)
    _grow(bins, g, h, rows[~left], depth - 1, (*path, (j, True, k)), out, value)


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 600) -> tuple[np.ndarray, float]:
    """L1-penalised logistic weights by accelerated proximal gradient; the intercept is free."""
    n, m = r.shape
    x = np.hstack([r, np.ones((n, 1))])
    v = np.ones(m + 1)
    for _ in range(30):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v)
    rate = 4 * n / max(np.linalg.norm(x @ v) ** 2, 1e-9)
    w = at = np.zeros(m + 1)
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -40, 40)))
        new = at - rate * (x.T @ (p - y)) / n
        new[:m] = np.sign(new[:m]) * np.maximum(np.abs(new[:m]) - rate * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        at = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return w[:m], float(w[m])


def fit_rules(stats: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, penalty: float = 1e-3) -> RuleModel:
    """Boosted shallow trees give the rules, a lasso logistic regression their weights."""
    if len(y) == 0:
        return RuleModel()
    cuts = [np.unique(np.quantile(stats[:, j], np.linspace(0, 1, 64)[1:-1])) for j in range(stats.shape[1])]
    bins = np.stack([np.searchsorted(c, stats[:, j], "left") for j, c in enumerate(cuts)], 1)
    score = np.full(len(y), np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    paths: list[tuple] = []
    rng = np.random.default_rng(3)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        use = np.flatnonzero(rng.random(len(y)) < 0.7)
        value = np.zeros(len(y))
        grown: list[tuple] = []
        _grow(bins, p - y, p * (1 - p), use, depth, (), grown, value)
        paths += grown
        score[use] += 0.3 * value[use]
    rules: dict[tuple, np.ndarray] = {}
    for path in paths:
        tight: dict[tuple, int] = {}
        for j, above, k in path:
            tight[j, above] = (max if above else min)(tight.get((j, above), k), k)
        rule = tuple(sorted((j, above, k) for (j, above), k in tight.items()))
        holds = np.all([(bins[:, j] > k) == above for j, above, k in rule], 0)
        rules.setdefault(rule, holds)
    if not rules:
        return RuleModel([], [], float(score[0]))
    weights, intercept = _lasso(np.stack(list(rules.values()), 1).astype(float), y, penalty)
    kept = [(r, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-6]
    named = [tuple((STATISTICS[j], above, float(cuts[j][k])) for j, above, k in r) for r, _ in kept]
    return RuleModel(named, [w for _, w in kept], intercept)


def add_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the struct ``stats``; a column of that name is replaced."""
    fields = ", ".join(f"{s}: double" for s in STATISTICS)

    def make():
        return lambda texts: [[dict(zip(STATISTICS, statistics(t))) for t in texts]]

    return with_columns(docs, [text], make, f"stats struct<{fields}>")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> RuleModel:
    """Fit on at most ``sample_rows`` labelled documents, chosen by a hash of the key.

    Null labels are left out; of repeated labels of a key the least counts.
    Without labelled rows every score is 0.5.
    """
    marked = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min(label).cast("int").alias("y"))
    picked = by_hash(marked, "k", sample_rows)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(picked), "k")
    found = add_statistics(rows, "t").select("k", "y", "stats.*").limit(4 * sample_rows).collect()
    found = sorted(tuple(r) for r in found)
    return fit_rules(np.array([r[2:] for r in found]), np.array([r[1] for r in found], float))


def score(docs: DataFrame, model: RuleModel, text: str = "text") -> DataFrame:
    """Add ``score`` and ``predicted``; the statistics come from the whole text, the rules are Spark expressions."""
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    counted = add_statistics(docs.select(*kept), text)
    value = model.column(lambda s: F.col(f"stats.{s}"))
    return counted.withColumn("score", value).select(*kept, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = remainder(F.col("doc_id"), 3) == 1
    model = fit(docs.where(~held), table(spark, sf_dir, "labels").where(remainder(F.col("doc_id"), 3) != 1))
    return score(docs.withColumn("held_out", held), model).select("doc_id", "held_out", "score", "predicted")
