"""Spans of a text and their digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<kind: string, start: int, end: int, score: double>>"


def as_rows(spans) -> list[dict]:
    return [{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in spans]


def joined(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def of_kind(spans: Column, kinds: Sequence[str]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def apart(span: tuple[int, int], taken: list[tuple[int, int]]) -> bool:
    """Whether a span meets none of the taken ones."""
    return all(span[1] <= a or span[0] >= b for a, b in taken)
