"""Logistic classification of plays from their zone counts.

Rows that agree in their features are one case: the table is counted per
distinct feature vector once, and every step of the fit is one aggregate over
those cases. A vector of counts has few values, so the cases stay few however
many plays there are; nothing but the sums of a step, a small square, reaches
the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turfline.functions.lineage import cut_lineage
from turfline.operators.scoring import accuracy

FEATURES = ("blitz", "middle", "hooks", "flat")
#: Newton steps from zero weights. Each doubles the digits that hold; eight are as many as doubles have.
STEPS = 8
#: Added to the diagonal, so that features which others determine get a solution.
RIDGE = 1e-9


@dataclass(frozen=True)
class Logit:
    """Weights of the intercept and of the features."""

    features: tuple[str, ...]
    weights: tuple[float, ...]

    def score(self) -> Column:
        """Intercept and weighted features, summed in their order."""
        out = F.lit(self.weights[0])
        for name, weight in zip(self.features, self.weights[1:]):
            out = out + F.lit(weight) * F.col(name)
        return out

    def odds(self) -> Column:
        return 1.0 / (1.0 + F.exp(-self.score()))


def cases(df: DataFrame, features: Sequence[str] = FEATURES, label: str = "hierarchy") -> DataFrame:
    """Rows and positive rows per distinct feature vector; rows with a missing value are left out."""
    whole = df.dropna(subset=[*features, label])
    return whole.groupBy(*features).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("positive"))


def newton_step(counted: DataFrame, model: Logit) -> Logit:
    """Weights after one Newton step of the likelihood."""
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in model.features]]
    odds = model.odds()
    spread = F.col("n") * odds * (1.0 - odds)
    size = len(x)
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    gradient = [F.sum((F.col("positive") - F.col("n") * odds) * v).alias(f"g{i}") for i, v in enumerate(x)]
    curvature = [F.sum(spread * x[i] * x[j]).alias(f"h{i}_{j}") for i, j in pairs]
    sums = counted.agg(*gradient, *curvature).first()
    if sums["g0"] is None:  # no rows
        return model
    h = np.zeros((size, size))
    for i, j in pairs:
        h[i, j] = h[j, i] = sums[f"h{i}_{j}"]
    step = np.linalg.solve(h + RIDGE * np.eye(size), [sums[f"g{i}"] for i in range(size)])
    return Logit(model.features, tuple(float(w) for w in np.add(model.weights, step)))


def logistic_fit(df: DataFrame, features: Sequence[str] = FEATURES, label: str = "hierarchy", steps: int = STEPS) -> Logit:
    """Binomial model with a logit link, a fixed number of Newton steps over the counted cases."""
    counted = cut_lineage(cases(df, features, label))
    model = Logit(tuple(features), (0.0,) * (len(features) + 1))
    for _ in range(steps):
        model = newton_step(counted, model)
    return model


def logistic_predict(model: Logit, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Add the odds and the 0/1 call, as column expressions."""
    return df.withColumn("odds", model.odds()).withColumn("pred", (F.col("odds") > threshold).cast("int"))


def logistic_fit_score(
    split: DataFrame,
    fit_on: Sequence[str] = ("ana",),
    score: Sequence[str] = ("ana", "assess"),
    features: Sequence[str] = FEATURES,
    label: str = "hierarchy",
    merged: dict[str, str] | None = None,
) -> DataFrame:
    """Fit on some sets of a split table, give accuracy on others.

    ``merged`` renames sets before scoring, as in ``{"ana": "train", "assess": "train"}``.
    """
    model = logistic_fit(split.where(F.col("set").isin(*fit_on)), features, label)
    rows = split.where(F.col("set").isin(*score))
    for old, new in (merged or {}).items():
        rows = rows.withColumn("set", F.when(F.col("set") == old, new).otherwise(F.col("set")))
    return accuracy(logistic_predict(model, rows), ["set"], label, "pred", rate="accuracy")
