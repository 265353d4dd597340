"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turfline.llm.common import flat_rows, remainder, table, with_columns

#: Buckets of hashed n-grams.
BUCKETS = 1 << 14
#: Most labelled rows per language that the model is fitted on (the documented bound of the sample).
ROWS_PER_LANGUAGE = 800
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Counts of the hashed 1- to 3-grams of a whole text; None if it has no letter.

    Letters are lower-cased; every run of other characters is one space.
    """
    code = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32)
    letter = _letters()[code]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    c = np.concatenate(([32], np.where(letter, code, 32)[keep], [32])).astype(np.uint64)
    mix, total = np.uint64(0x9E3779B97F4A7C15), np.zeros(BUCKETS, np.int64)
    h = c
    for n in range(1, 4):
        if n > 1:
            h = h[:-1] * np.uint64(0x100000001B3) + c[n - 1 :]
        total += np.bincount(((h * mix) >> np.uint64(50)).astype(np.int64), minlength=BUCKETS)
    return total


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets x languages, mostly zero
    temperature: float

    def logits(self, counts: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(counts)
        x = np.log1p(counts[at]) * self.idf[at]
        return x @ self.weights[at] / max(np.sqrt(x @ x), 1e-12)

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = ngram_counts(text)
        if counts is None or not self.languages:
            return UNKNOWN, 0.0
        p = _softmax(self.logits(counts) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _ftrl(rows: list, y: np.ndarray, k: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """Follow-the-regularised-leader with elastic-net penalties, one row at a time."""
    z, n = np.zeros((BUCKETS, k)), np.zeros((BUCKETS, k))

    def weights(z, n):
        return -np.sign(z) * np.maximum(np.abs(z) - l1, 0) / ((beta + np.sqrt(n)) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            p = _softmax(x @ w)
            p[y[i]] -= 1
            g = x[:, None] * p
            n_new = ni + g * g
            z[at] = zi + g - (np.sqrt(n_new) - np.sqrt(ni)) / alpha * w
            n[at] = n_new
    return weights(z, n)


def fit(
    docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
    rows_per_language: int = ROWS_PER_LANGUAGE, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3,
) -> LanguageModel:
    """Fit on at most ``rows_per_language`` different labelled rows of each language, chosen by a hash of the row.

    A fifth of the sample sets the temperature. Rows without a language or
    without a letter are skipped; without any row, everything is ``und``.
    """
    # The hash of the whole row: rows without key, or with one key, are told apart.
    row = F.xxhash64(F.col(text), F.col(lang), F.col(key), F.lit(10))
    labelled = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("l"), F.col(text).alias("t"), row.alias("h"))
    sizes = labelled.groupBy("l").agg(F.count(F.lit(1)).alias("n"))  # one row per language
    # A threshold lets about twice the wanted rows through; of those, equal rows count once and the exact cut follows.
    low = F.pmod(F.col("h"), F.lit(1 << 32)) <= F.least(F.lit(1.0), 2.0 * rows_per_language / F.col("n")) * (1 << 32)
    once = labelled.join(F.broadcast(sizes), "l").where(low).groupBy("l", "h").agg(F.first("t").alias("t"))
    rank = F.row_number().over(Window.partitionBy("l").orderBy("h"))
    picked = once.withColumn("r", rank).where(F.col("r") <= rows_per_language)

    def counted():
        def of(langs, hashes, texts):
            out = [], [], [], []
            for x, h, t in zip(langs, hashes, texts):
                if (c := ngram_counts(t)) is not None:
                    at = np.flatnonzero(c)
                    for o, v in zip(out, (x, h, at, c[at])):
                        o.append(v)
            return out

        return of

    rows = flat_rows(picked, ["l", "h", "t"], counted, "l string, h long, at array<int>, n array<int>").collect()
    rows = sorted(rows, key=lambda r: (r.h, r.l, len(r.at)))
    languages = sorted({r.l for r in rows})
    df = np.zeros(BUCKETS)
    for r in rows:
        df[r.at] += 1
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    data = []
    for r in rows:
        at = np.asarray(r.at)
        x = np.log1p(np.asarray(r.n)) * idf[at]
        data.append((at, x / np.sqrt(x @ x)))
    y = np.array([languages.index(r.l) for r in rows], int)
    model = LanguageModel(languages, idf, np.zeros((BUCKETS, len(languages))), 1.0)
    if len(languages) < 1:
        return model
    held = np.arange(len(rows)) % 5 == 0 if len(rows) >= 20 else np.zeros(len(rows), bool)
    model.weights = _ftrl([d for d, out in zip(data, held) if not out], y[~held], len(languages), epochs, alpha, beta, l1, l2)
    if held.any():
        z = np.array([x @ model.weights[at] for (at, x), out in zip(data, held) if out])
        nll = lambda t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(z)), y[held]], 1e-12)).mean()
        model.temperature = float(min(np.geomspace(0.05, 5, 60), key=nll))
    return model


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (calibrated probability) from the whole text of every row.

    Null, empty and letterless texts are ``und`` with score 0. Repeated rows
    get equal answers; columns named like the outputs are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def of(texts):
            found = [shared.value.predict(t) for t in texts]
            return [f[0] for f in found], [f[1] for f in found]

        return of

    return with_columns(docs, [text], make, "lang_pred string, score double")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = remainder(F.col("doc_id"), 5) == 0
    model = fit(docs.where(~held))
    return identify(docs.select("doc_id", "text", held.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.5) -> DataFrame:
    """Pipeline stage: drop documents without a letter or whose best language is less likely than ``least``."""
    model = fit(docs)
    out = identify(docs, model)
    sure = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)
    return out.where(sure).select(*docs.columns)
