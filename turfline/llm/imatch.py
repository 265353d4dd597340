"""I-Match fingerprints: hashes of the sorted mid-frequency terms under several randomised lexicons."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turfline.functions.lineage import cut_lineage
from turfline.llm.common import table

#: Share of the documents that a term of the lexicon occurs in: at least, at most (the band of
#: inverse document frequencies). At least LEAST_SHARE of N documents bounds the lexicon:
#: it has at most (mean number of distinct terms of a document) / LEAST_SHARE terms, for any N.
LEAST_SHARE, MOST_SHARE = 0.01, 0.3
#: A term belongs to random lexicon i if bits 4i to 4i+3 of its hash are below SUBSETS[i].
SUBSETS = (8, 8, 8, 8, 4, 4, 4, 4, 4, 4, 2, 2, 2, 1, 1, 1)
#: A text is known by its band terms if it has so many, or if they are such a share of its terms.
FEW, LEAST_PART = 8, 0.25
#: Stands for a missing key, after all others.
NO_KEY = -(1 << 63)
#: Rows per range of the neighbour step, as long as there are no more ranges than MOST_RANGES (one row of
#: each is broadcast); quantiles that place the ranges before they are divided evenly.
RANGE_ROWS, MOST_RANGES, QUANTILES = 4000, 100_000, 200


def terms(text: Column) -> Column:
    """Hashes of the distinct lower-cased runs of letters and digits."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, text: str = "text", least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """Term hashes inside the band, counted over all documents: ``term``, ``n_docs``.

    Terms of two documents at least, so that a tiny corpus has a lexicon of
    shared terms; an empty corpus has none.
    """
    total = docs.agg(F.count(F.lit(1)).alias("n_all"))
    counts = docs.select(F.explode(terms(F.col(text))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"))
    n = total.scalar()
    band = counts.where((F.col("n_docs") >= F.greatest(F.lit(2.0), n * least)) & (F.col("n_docs") <= F.greatest(F.lit(2.0), n * most)))
    return cut_lineage(band)


def lookup(words: DataFrame) -> tuple[Column, int, int]:
    """The lexicon as one constant: a hash table in an array, its number of slots, and the places of a slot.

    The lexicon passes through the driver; its size is bounded whatever the corpus (see LEAST_SHARE).
    """
    held = np.array(sorted(r.term for r in words.select("term").collect()), np.int64)
    slots = 1 << max(len(held), 1).bit_length()
    slot = held & (slots - 1)
    order = np.argsort(slot, kind="stable")
    held, slot = held[order], slot[order]
    place = np.arange(len(held)) - np.searchsorted(slot, slot)
    places = int(place.max(initial=0)) + 1
    # A free place holds a number that belongs to another slot.
    packed = np.repeat(~np.arange(slots, dtype=np.int64), places)
    packed[slot * places + place] = held
    # Written as a text that the optimiser folds into one array constant.
    return F.split(F.lit(",".join(map(str, packed.tolist()))), ",").cast("array<bigint>"), slots, places


def with_fingerprint(docs: DataFrame, text: str, out: str, lexicon_table: tuple[Column, int, int]) -> DataFrame:
    """Add an array of one hash per random lexicon; null where the lexicon has no term of the text.

    A text with few terms of the band (see FEW) is hashed over all its terms, as
    unrelated texts can share a few common ones; a text without terms has nulls
    only. Every step is a column of its own, so that no step is computed twice.
    """
    kept = [c for c in docs.columns if c != out]
    held, slots, places = lexicon_table
    found = docs.select(*kept, terms(F.col(text)).alias("__terms"))
    in_slot = lambda t: F.slice(held, (t.bitwiseAND(F.lit(slots - 1)) * places + 1).cast("int"), F.lit(places))
    banded = found.select(*kept, "__terms", F.filter("__terms", lambda t: F.array_contains(in_slot(t), t)).alias("__banded"))
    n_banded = F.size("__banded")
    told = (n_banded > 0) & ((n_banded >= FEW) | (n_banded >= LEAST_PART * F.size("__terms")))
    ids = banded.select(*kept, F.sort_array(F.when(told, F.col("__banded")).otherwise(F.col("__terms"))).alias("__ids"))
    subsets = ids.select(*kept, *[_subset(F.col("__ids"), i, below).alias(f"__s{i}") for i, below in enumerate(SUBSETS)])
    hashes = [F.when(F.size(f"__s{i}") > 0, F.xxhash64(f"__s{i}")) for i in range(len(SUBSETS))]
    return subsets.select(*kept, F.array(*hashes).alias(out))


def _subset(ids: Column, i: int, below: int) -> Column:
    return F.filter(ids, lambda t: F.shiftrightunsigned(t, 4 * i).bitwiseAND(F.lit(15)) < below)


def as_text(fp: Column) -> Column:
    """Hexadecimal form, sixteen characters a lexicon; dashes where it has no term."""
    return F.concat_ws("", F.transform(fp, lambda h: F.coalesce(F.lower(F.lpad(F.hex(h), 16, "0")), F.lit("-" * 16))))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the lexicons that have a term of either text; 1 if none has."""
    both = F.arrays_zip(a.alias("a"), b.alias("b"))
    either = F.size(F.filter(both, lambda p: p["a"].isNotNull() | p["b"].isNotNull()))
    same = F.size(F.filter(both, lambda p: p["a"] == p["b"]))
    return F.when(either == 0, F.lit(1.0)).otherwise(same.cast("double") / either)


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint`` (hex text): equal texts have equal ones. Null texts count as empty."""
    return with_fingerprint(docs, text, "__fp", lookup(lexicon(docs, text))).withColumn("fingerprint", as_text(F.col("__fp"))).drop("__fp")


def range_of(docs: DataFrame, at: Column, tie: Column) -> Column:
    """Number of a row's range; ranges follow ``at``, then ``tie`` (64-bit hash), and hold about RANGE_ROWS rows each.

    Quantiles cut coarse ranges, and a value that fills one is a range of its
    own. Each is divided evenly by as many pieces as its rows need: by key, or
    by the hash if it holds one key only, as that of all rows without one.
    """
    keys = docs.select(at.alias("at"))
    n = keys.count()
    rows = max(RANGE_ROWS, -(-n // MOST_RANGES))
    coarse = min(max(n // rows, 1), QUANTILES)
    probs = [i / coarse for i in range(1, coarse)]
    found = (keys.agg(F.percentile_approx("at", probs, 10_000)).first()[0] or []) if probs else []
    alone = {c - 1 for c, after in zip(found, found[1:]) if c == after and c > NO_KEY}
    cuts = sorted({*found, *alone})
    below = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < at)) if cuts else F.lit(0)
    ends = docs.select(below.alias("i"), at.alias("at")).groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("low"), F.max("at").alias("high"))
    sizes = {r.i: r for r in ends.collect()}  # a row per coarse range
    low, width, pieces, base, used = [], [], [], [], 0
    for i in range(len(cuts) + 1):
        r = sizes.get(i)
        low.append(float(r.low) if r else 0.0)
        width.append(float(r.high) - float(r.low) if r else 0.0)
        pieces.append(-(-r.n // rows) if r else 1)
        base.append(used)
        used += pieces[-1]
    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), below + 1)
    place = F.when(of(width) > 0, (at.cast("double") - of(low)) / of(width)).otherwise(tie.cast("double") / 2.0**64 + 0.5)
    return of(base) + F.least(F.floor(place * of(pieces)).cast("int"), of(pieces) - 1)


def in_ranges(docs: DataFrame, key: str, tied: list[str]) -> DataFrame:
    """``docs`` in ranges of the key, each with a copy of the first row of the range after it (see ``followed``)."""
    at = F.coalesce(F.col(key), F.lit(NO_KEY))
    tie = F.xxhash64(*tied)
    placed = docs.withColumns({"__at": at, "__tie": tie, "__range": range_of(docs, at, tie), "__copy": F.lit(0)})
    # A row per range that has rows: its first row's place, and the range before it.
    tops = placed.groupBy("__range").agg(F.max(F.struct("__at", "__tie")).alias("top"))
    ring = Window.orderBy(F.desc("__range"))
    before = tops.withColumns({"__for": F.lag("__range").over(ring), "__low": F.min("__range").over(Window.partitionBy(F.lit(1)))})
    heads = F.broadcast(before.select("__range", "top.*", F.coalesce("__for", "__low").alias("__for")))
    # Rows with the key and hash of a top are equal in all that counts; one of them is copied.
    first = F.row_number().over(Window.partitionBy("__range").orderBy(F.desc("__tie")))
    copies = placed.join(heads, ["__range", "__at", "__tie"]).withColumn("__first", first).where("__first = 1")
    copies = copies.select(*docs.columns, "__at", "__tie", F.col("__for").alias("__range"), F.lit(1).alias("__copy"))
    return placed.select(*docs.columns, "__at", "__tie", "__range", "__copy").unionByName(copies)


def followed(rows: DataFrame, carried: list[str]) -> DataFrame:
    """Rows of ``in_ranges`` with ``next_<column>`` of the row that follows."""
    order = Window.partitionBy("__range").orderBy("__copy", F.desc("__at"), F.desc("__tie"))
    found = rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried})
    return found.where("__copy = 0").drop("__at", "__tie", "__range", "__copy")


def with_next(docs: DataFrame, key: str, carried: list[str]) -> DataFrame:
    """Add ``next_<column>`` of the following row by descending ``key`` (after the last: the first).

    Rows are cut into ranges of the key; each range also gets a copy of the
    first row of the range after it, so one window per range gives every row
    its follower. Null keys come last; rows with equal keys are ordered by the
    hash of the carried columns.
    """
    return followed(in_ranges(docs, key, carried), carried)


def op2_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    held = lookup(lexicon(docs))
    own = with_fingerprint(in_ranges(docs, "doc_id", ["text"]), "text", "fp", held)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    halves = (
        followed(own, ["text", "fp"])
        .withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
        .select("doc_id", n.cast("long").alias("n_chars"), "edited", "fp", "next_fp")
    )
    edited = with_fingerprint(halves, "edited", "edited_fp", held)
    return edited.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
