"""Repeatable sampling: every choice is a function of the row key and a seed.

No row is shuffled to be assigned to a set, and a retried task gives the same
answer as the first attempt.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_hash(keys: Sequence[str], seed: int = 15) -> Column:
    """Hex text, evenly spread, from the key columns and a seed."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def hex_threshold(prop: float) -> str:
    """Eight hex digits below which a share ``prop`` of all hashes falls."""
    if not 0 <= prop <= 1:
        raise ValueError("a share lies between 0 and 1")
    return "g" if prop == 1 else f"{int(prop * 2**32):08x}"


def train_split(
    df: DataFrame, keys: Sequence[str], prop: float = 0.8, inner: float = 0.75, seed: int = 15, out: str = "set"
) -> DataFrame:
    """Tag each row ``ana``, ``assess`` or ``test``.

    ``prop`` of the rows are for training; of those ``inner`` are for fitting
    and the rest for choosing between fits. Sizes are close to, not exactly,
    the shares asked for.
    """
    outer_hash, inner_hash = row_hash(keys, seed), row_hash(keys, seed + 1)
    return df.withColumn(
        out,
        F.when(outer_hash >= hex_threshold(prop), "test")
        .when(inner_hash < hex_threshold(inner), "ana")
        .otherwise("assess"),
    )


def kfold(df: DataFrame, keys: Sequence[str], folds: int = 5, seed: int = 15, out: str = "fold") -> DataFrame:
    """Tag each row with a fold 1..folds."""
    h = row_hash(keys, seed)
    fold = F.when(h < hex_threshold(1 / folds), 1)
    for i in range(2, folds):
        fold = fold.when(h < hex_threshold(i / folds), i)
    return df.withColumn(out, fold.otherwise(folds))


def sample_rows(df: DataFrame, keys: Sequence[str], n: int = 1, seed: int = 15) -> DataFrame:
    """``n`` rows chosen by hash; runs as a top-n, never as a full sort."""
    return df.withColumn("_h", row_hash(keys, seed)).orderBy("_h", *keys).limit(n).drop("_h")


def sample_group(df: DataFrame, keys: Sequence[str], seed: int = 15) -> DataFrame:
    """All rows of one group chosen by hash.

    The choice is a global minimum, so each task sends one row; the join side
    is that single row.
    """
    chosen = df.agg(F.min_by(F.struct(*keys), row_hash(keys, seed)).alias("_k")).select("_k.*")
    return df.join(F.broadcast(chosen), list(keys), "left_semi")


def zscore(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Centre and scale columns over the whole table (sample deviation).

    The moments come from one partial aggregate and reach the rows as a scalar
    subquery.
    """
    moments = df.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
        *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(cols)],
    )
    one = moments.select(F.struct(*moments.columns).alias("_m")).scalar()
    tagged = df.withColumn("_m", one)
    return tagged.withColumns(
        {c: F.try_divide(F.col(c) - F.col(f"_m.m{i}"), F.col(f"_m.s{i}")) for i, c in enumerate(cols)}
    ).drop("_m")
