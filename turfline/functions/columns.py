"""Column expressions with the null, tie and bin rules of the analyses.

Every helper takes and returns ``Column`` objects, so the work stays inside
whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def as_col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def if_else(cond: Column, yes, no) -> Column:
    """Two-way choice that is null where the condition is null."""
    return F.when(cond, yes).when(~cond, no)


def cut(value, breaks: Sequence[float], labels: Sequence, include_lowest: bool = False) -> Column:
    """Label of the half-open bin ``(lo, hi]`` holding ``value``; null outside all bins."""
    if len(labels) != len(breaks) - 1:
        raise ValueError("a cut needs one label per bin")
    value = as_col(value)
    out = None
    for i, label in enumerate(labels):
        lo, hi = F.lit(float(breaks[i])), F.lit(float(breaks[i + 1]))
        above = value >= lo if include_lowest and i == 0 else value > lo
        hit = above & (value <= hi)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out


def _ordered(value, desc: bool) -> Column:
    value = as_col(value)
    return value.desc_nulls_last() if desc else value.asc_nulls_last()


def min_rank(value, by: Sequence[str], desc: bool = False) -> Column:
    """Rank in a group, ties share the smallest rank, nulls rank last."""
    return F.rank().over(Window.partitionBy(*by).orderBy(_ordered(value, desc)))


def avg_rank(value, by: Sequence[str], desc: bool = False) -> Column:
    """Rank in a group where ties share the mean of the ranks they cover.

    The default frame of a count ends with the last tie, so both ends of the
    ranks come from one window.
    """
    w = Window.partitionBy(*by).orderBy(_ordered(value, desc))
    return (F.rank().over(w) + F.count(F.lit(1)).over(w)) / F.lit(2.0)


def share(value, by: Sequence[str] = ()) -> Column:
    """``value`` as a part of its group's total."""
    value = as_col(value)
    return F.try_divide(value.cast("double"), F.sum(value).over(Window.partitionBy(*by)))


def strict_mean(value) -> Column:
    """Mean that is null as soon as one input is null."""
    value = as_col(value)
    return F.when(F.count(value) == F.count(F.lit(1)), F.avg(value))


def sub_first(value, pattern: str, replacement: str) -> Column:
    """Replace only the first match of ``pattern``."""
    return F.regexp_replace(as_col(value), f"^(.*?){pattern}", "$1" + replacement)


def text(value) -> Column:
    """Text of a value, with a missing value spelled ``NA``."""
    return F.coalesce(as_col(value).cast("string"), F.lit("NA"))


def paste(*values, sep: str = " ") -> Column:
    return F.concat_ws(sep, *[text(v) for v in values])


def ordinal(number) -> Column:
    """1st, 2nd, 3rd, 4th ... 11th, 12th, 13th ... 21st."""
    n = as_col(number)
    teens = F.pmod(n, F.lit(100)).between(11, 13)
    last = F.pmod(n, F.lit(10))
    suffix = (
        F.when(teens, "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th")
    )
    return F.concat(n.cast("string"), suffix)


def yard_label(position) -> Column:
    """Yard number painted at a rotated field position."""
    away = F.abs(as_col(position))
    return if_else(away > 60, 110 - away, away - 10)


def big_number(value) -> Column:
    """Whole number with thousands commas."""
    return F.format_number(as_col(value).cast("double"), 0)


def percent(value, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", as_col(value).cast("double") * 100)


def scientific(value, digits: int = 2) -> Column:
    return F.when(as_col(value).isNotNull(), F.format_string(f"%.{digits}e", as_col(value).cast("double")))
