"""Joins and ranks that stay balanced when one key holds much of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turfline.functions.lineage import cut_lineage

#: A key with more rows than this is joined on the map side. A table of R rows
#: has at most R / HOT_ROWS such keys, which bounds what is broadcast.
HOT_ROWS = 5_000_000
#: Rows per piece that a hot key is spread over after the map-side join.
PIECE_ROWS = 250_000


def has_hot(per_key: DataFrame, hot_rows: int | None, n_rows: str = "n_rows") -> bool:
    """Whether some key has more rows than ``hot_rows``."""
    return hot_rows is not None and n_rows in per_key.columns and not per_key.where(F.col(n_rows) > hot_rows).isEmpty()


def attach(
    rows: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    n_rows: str = "n_rows",
    hot_rows: int | None = HOT_ROWS,
    only: Column | None = None,
) -> DataFrame:
    """Inner join of ``rows`` to ``per_key``, safe when one key holds much of ``rows``.

    ``only`` is a condition over both sides that the result has to meet; given
    here rather than in a later filter, it leaves the sides of the join alone.

    ``rows`` are never gathered, whatever sizes the planner guesses: they are
    the preserved side of an outer join, and rows without a partner are dropped
    after it. They stream past hashed partitions of ``per_key`` and are not
    sorted; if they are laid out by ``keys`` already they are not moved either.
    If ``per_key`` carries the row count of its keys in ``n_rows`` and some key
    is above ``hot_rows``, such keys are matched by a broadcast join first
    (there are few of them by definition), and their rows pass the other join
    under a key salted with as many pieces as they have ``PIECE_ROWS`` rows.
    Finding them reads ``per_key`` once; pass a written table.

    ``hot_rows=None`` gives the plain join, right for tables bucketed by the key.
    """
    keys = list(keys)
    payload = [c for c in per_key.columns if c not in (*keys, n_rows)]
    if not has_hot(per_key, hot_rows, n_rows):
        marked = per_key.select(*keys, *payload, F.lit(1).cast("bigint").alias("_met"))
        # Always 1 for a partner and never without one. The hash of the left keys
        # keeps the optimizer from proving that, which would make the join an
        # inner one with a free choice of side.
        found = F.col("_met") if only is None else F.when(only, F.col("_met"))
        met = F.coalesce(found, F.least(F.lit(0).cast("bigint"), F.xxhash64(*keys))) == 1
        return rows.join(marked.hint("shuffle_hash"), keys, "left").where(met).select(*rows.columns, *payload)
    is_hot = F.coalesce(F.col(n_rows), F.lit(0)) > hot_rows
    value = F.struct(*payload)
    hot = per_key.where(is_hot).select(*keys, value.alias("_hot"), F.ceil(F.col(n_rows) / F.lit(PIECE_ROWS)).alias("_pieces"))
    # Zero for every cold key, but not a literal: the optimizer would fold that
    # out of the join key and leave the hot rows unsalted.
    zero = is_hot.cast("bigint")
    cold = per_key.where(~is_hot).select(*keys, zero.alias("_salt"), value.alias("_cold"))
    salt = F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(*spread_by), F.col("_pieces")))
    joined = (
        rows.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", salt.cast("bigint"))
        .join(cold.hint("shuffle_hash"), [*keys, "_salt"], "left")
        .withColumn("_dim", F.coalesce("_hot", "_cold"))
        .where(F.col("_dim").isNotNull())
        .select(*rows.columns, *[F.col(f"_dim.{c}").alias(c) for c in payload])
    )
    return joined if only is None else joined.where(only)


def running_total(
    df: DataFrame, by: Sequence[str], order: Sequence[str], weight: Column, out: str, pieces: int | None = None
) -> DataFrame:
    """Add the sum of ``weight`` over the rows before each row of its group, zero for the first.

    A group may be of any size: rows are cut into ranges of group and order, so
    a large group spans many pieces. Each piece is summed in its own window and
    moved up by the totals of the group's earlier pieces, which are one row per
    group and piece. Nulls come first, in groups and in the order. Rows that
    agree in all of ``order`` must be equal or end in one piece in any order;
    ``df`` must give the same rows when it is read again (a written table or an
    aggregate).
    """
    by, order = list(by), list(order)
    ends = [F.asc_nulls_first(c) for c in (*by, *order)]
    ranged = df.repartitionByRange(pieces, *ends) if pieces else df.repartitionByRange(*ends)
    placed = cut_lineage(ranged.withColumns({"_piece": F.spark_partition_id(), "_w": weight.cast("bigint")}))
    totals = placed.groupBy(*by, "_piece").agg(F.sum("_w").alias("_total"))
    # One row per group and piece: no window holds more rows than there are pieces.
    earlier = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    named = {b: f"_k{i}" for i, b in enumerate(by)}
    shifts = totals.select(
        *[F.col(b).alias(k) for b, k in named.items()],
        F.col("_piece").alias("_at"),
        F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_shift"),
    )
    inside = Window.partitionBy(*by, "_piece").orderBy(*[F.asc_nulls_first(c) for c in order])
    before = F.coalesce(F.sum("_w").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = F.col("_piece") == F.col("_at")
    for b, k in named.items():
        same = same & F.col(b).eqNullSafe(F.col(k))
    summed = placed.withColumn("_before", before).join(shifts, same)
    return summed.select(*[c for c in df.columns if c != out], (F.col("_before") + F.col("_shift")).alias(out))


def spread_rank(
    df: DataFrame, by: Sequence[str], value: str, out: str, desc: bool = False, pieces: int | None = None
) -> DataFrame:
    """Add the min rank of a numeric ``value`` in its group; a group may be of any size.

    Equal values are counted first, so a value that fills a group is one row.
    The rank is one more than the running total of the counts, see
    ``running_total``: pieces are cut by group and value, as many as the data
    need. Nulls rank last.
    """
    by = list(by)
    v = -F.col(value) if desc else F.col(value)
    counts = df.groupBy(*by, v.isNull().alias("_none"), v.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ranks = running_total(counts, by, ["_none", "_v"], F.col("_n"), "_below", pieces)
    named = [f"_k{i}" for i in range(len(by))]
    ranks = ranks.select(*[F.col(b).alias(k) for b, k in zip(by, named)], "_v", (F.col("_below") + 1).cast("int").alias("_rank"))
    same = v.eqNullSafe(F.col("_v"))
    for b, k in zip(by, named):
        same = same & F.col(b).eqNullSafe(F.col(k))
    return df.join(ranks, same).withColumn(out, F.col("_rank")).select(*[c for c in df.columns if c != out], out)
