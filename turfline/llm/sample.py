"""Bounded samples chosen by hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_hash(df: DataFrame, hashed: str | Sequence[str], rows: int, n_rows: int | None = None) -> DataFrame:
    """The ``rows`` rows with the least hashes, ties by the other columns; a rerun gives the same.

    A threshold on the hash lets through about twice as many, so that the final
    sort gets few rows from however many tasks. That holds if the hashed columns
    tell the rows apart; rows with equal ones pass or fail together. ``n_rows``
    is the size of ``df``, if known.
    """
    n = df.count() if n_rows is None else n_rows
    share = min(1.0, 2 * rows / max(n, 1))
    low = F.pmod(F.xxhash64(*([hashed] if isinstance(hashed, str) else hashed)), F.lit(1 << 32))
    return df.where(low <= int(share * (1 << 32))).orderBy(low, *df.columns).limit(rows)
