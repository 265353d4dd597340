"""Scoring stored predictions: accuracy, recall, confusion and play selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turfline.functions.columns import big_number, if_else, min_rank, ordinal, percent, scientific, share
from turfline.functions.lineage import cut_lineage
from turfline.functions.sampling import sample_rows
from turfline.operators.formations import named_formation
from turfline.operators.tracking import PLAY

ONE_HIGH, TWO_HIGH = "1-High", "2-High"
OPEN_FORMATIONS = ("empty open", "3x1 open", "2x2 open", "trey")
# Long coverage lists and the short name each stands for.
LONG_LABELS = {
    "Cover-2; Quarters; Cover-6; 2-Man": TWO_HIGH,
    "Cover-3; Cover-1": ONE_HIGH,
}


def call(odds="pred1", threshold: float = 0.5) -> Column:
    """1-High where the odds exceed the threshold, else 2-High."""
    return if_else(F.col(odds) > threshold, F.lit(ONE_HIGH), F.lit(TWO_HIGH))


def accuracy(df: DataFrame, by: Sequence[str], actual: str = "actual", pred: str = "pred", rate: str = "pct") -> DataFrame:
    """Rows, right answers and their ratio per group."""
    right = (F.col(actual) == F.col(pred)).cast("int")
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("count"), F.sum(right).alias("correct"))
    return out.withColumn(rate, F.try_divide(F.col("correct").cast("double"), F.col("count")))


def class_recall(df: DataFrame, actual: str, pred: str = "pred") -> DataFrame:
    """Share of each actual class that was predicted right, from the confusion counts."""
    cells = df.groupBy(actual, pred).agg(F.count(F.lit(1)).alias("n"))
    hit = F.coalesce(F.col(actual) == F.col(pred), F.lit(False))
    out = cells.groupBy(actual).agg(
        F.sum("n").alias("count"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("correct")
    )
    return out.withColumn("pct", F.try_divide(F.col("correct").cast("double"), F.col("count")))


def confusion_pct(
    df: DataFrame, by: Sequence[str], pred: str, values: Sequence, fill: float | None = None
) -> DataFrame:
    """Row-normalised confusion table, one column per predicted value.

    The value list is given, so the pivot needs no job of its own; the shares
    are taken over counted cells.
    """
    cells = df.groupBy(*by, pred).agg(F.count(F.lit(1)).alias("n")).withColumn("pct", share("n", by))
    wide = cells.groupBy(*by).pivot(pred, list(values)).agg(F.first("pct"))
    return wide if fill is None else wide.na.fill(fill, [str(v) for v in values])


def having_total(df: DataFrame, by: Sequence[str], col: str, minimum) -> DataFrame:
    """Rows of the groups whose total of ``col`` exceeds ``minimum``.

    The totals are aggregated before they are joined back, so a large group is
    summed on the map side and its rows are never gathered.
    """
    totals = df.groupBy(*by).agg(F.sum(col).alias("_total")).where(F.col("_total") > minimum)
    keys = [f"_k{i}" for i in range(len(by))]
    named = totals.select(*[F.col(b).alias(k) for b, k in zip(by, keys)])
    same = [F.col(b).eqNullSafe(F.col(k)) for b, k in zip(by, keys)]
    return df.join(named, same, "left_semi")


def with_formations(preds: DataFrame, formations: DataFrame, keys: Sequence[str] = PLAY) -> DataFrame:
    """Predictions beside the formation of their play."""
    return preds.join(formations, list(keys), "left")


def accuracy_by_formation(
    preds: DataFrame, formations: DataFrame, min_total: int = 500, min_count: int = 20
) -> DataFrame:
    """Accuracy per formation, backs and actual class, for common formations only."""
    named = named_formation(with_formations(preds, formations)).withColumn("pred", call())
    scored = accuracy(named, ["formation", "backs", "actual"])
    totals = Window.partitionBy("formation")
    # ``scored`` has one row per formation, backs and class: a small table.
    return (
        scored.withColumn("_total", F.sum("count").over(totals))
        .where((F.col("_total") > min_total) & (F.col("count") > min_count))
        .drop("_total")
    )


def accuracy_spread(scored: DataFrame, by: Sequence[str] = ("actual", "backs")) -> DataFrame:
    """Distance between the worst and best accuracy of a group: negative on the
    worst row, positive on the others."""
    w = Window.partitionBy(*by)
    worst = F.min("pct").over(w)
    gap = worst - F.max("pct").over(w)
    return scored.withColumn("diff", if_else(F.col("pct") == worst, gap, -gap))


def accuracy_by_defense(
    preds: DataFrame, formations: DataFrame, plays: DataFrame, named: Sequence[str] = OPEN_FORMATIONS
) -> DataFrame:
    """Accuracy per actual class, formation and defending team."""
    rows = named_formation(with_formations(preds, formations)).where(F.col("formation").isin(*named))
    teams = plays.select(*PLAY, "defensiveteam")
    joined = rows.join(teams, list(PLAY), "left").withColumn("pred", call())
    return accuracy(joined, ["actual", "formation", "defensiveteam"])


def false_positive_mix(preds: DataFrame, formations: DataFrame, threshold: float = 0.5) -> DataFrame:
    """What two-deep plays called one-deep were: by backs, formation and coverage."""
    wrong = with_formations(preds, formations).where((F.col("actual") == TWO_HIGH) & (F.col("pred1") > threshold))
    label = if_else(F.col("pff_passcoverage") == "Cover-6", F.lit("Quarters"), F.col("pff_passcoverage"))
    counts = (
        wrong.withColumn("pff_passcoverage", label)
        .groupBy("backs", "formation", "pff_passcoverage")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.withColumn("pct", share("n", [F.lit(0)]))


def with_clip_length(preds: DataFrame, formations: DataFrame, crop: DataFrame) -> DataFrame:
    """Predictions with named formation and number of frames from snap to clip."""
    frames = crop.select(*PLAY, (F.col("clip") - F.col("snap")).alias("frames"))
    return named_formation(with_formations(preds, formations)).join(frames, list(PLAY), "left")


def five_numbers(df: DataFrame, by: Sequence[str], col: str, accuracy: int = 1_000) -> DataFrame:
    """Exact quartiles and extremes per group, for groups of any size and any number of values.

    A quantile sketch of fixed size, merged over tasks, puts each quartile
    between two values that about 6 / ``accuracy`` of the rows lie between; in a
    group of fewer rows than ``accuracy`` these are its extremes. A second aggregate counts the rows below these brackets and the distinct
    values inside, and the quartile is read off at its exact place, between two
    neighbouring values in proportion.
    """
    by, quartiles = list(by), (0.25, 0.5, 0.75)
    # Written, as the rows are read twice.
    rows = cut_lineage(df.where(F.col(col).isNotNull()).select(*by, F.col(col).alias("_v")))
    # The sketch's error and two rows on either side of the quartile.
    slack = 3.0 / accuracy
    ends = [min(max(q + s, 0.0), 1.0) for q in quartiles for s in (-slack, slack)]
    summary = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"), F.min("_v").alias("low"), F.max("_v").alias("high"),
        F.percentile_approx("_v", ends, accuracy).alias("_ends"),
    )
    extremes = F.flatten(F.array_repeat(F.array("low", "high"), len(quartiles)))
    summary = summary.withColumn("_ends", F.when(F.col("count") < accuracy, extremes).otherwise(F.col("_ends")))
    summary = cut_lineage(summary)  # one row per group
    keys = {b: f"_k{i}" for i, b in enumerate(by)}
    marks = summary.select(*[F.col(b).alias(k) for b, k in keys.items()], "_ends")
    same = F.lit(True)
    for b, k in keys.items():
        same = same & F.col(b).eqNullSafe(F.col(k))
    # A row counts for a quartile below its bracket, without a value, or inside, with its value.
    parts = [
        F.when(F.col("_v") <= F.col("_ends")[2 * i + 1], F.struct(F.lit(i).alias("q"), F.when(F.col("_v") >= F.col("_ends")[2 * i], F.col("_v")).alias("v")))
        for i in range(len(quartiles))
    ]
    placed = rows.join(marks, same).select(*by, F.explode(F.array_compact(F.array(*parts))).alias("_p"))
    counted = placed.groupBy(*by, F.col("_p.q").alias("_q"), F.col("_p.v").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*by, "_q").orderBy(F.asc_nulls_first("_v"))
    ranked = counted.withColumn("_last", F.sum("_n").over(upto) - 1).withColumn("_first", F.col("_last") - F.col("_n") + 1)
    sizes = summary.select(*[F.col(b).alias(k) for b, k in keys.items()], "count")
    place = (F.col("count") - 1) * F.element_at(F.array(*[F.lit(q) for q in quartiles]), F.col("_q") + 1)

    def at(rank):
        return F.max(F.when(F.lit(rank).between(F.col("_first"), F.col("_last")), F.col("_v").cast("double")))

    found = ranked.join(sizes, same).withColumn("_at", place)
    ends_of = found.groupBy(*by, "_q").agg(at(F.floor("_at")).alias("_lo"), at(F.ceil("_at")).alias("_hi"), F.max(F.col("_at") - F.floor("_at")).alias("_share"))
    value = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_share")
    wide = ends_of.groupBy(*by).agg(*[F.max(F.when(F.col("_q") == i, value)).alias(n) for i, n in enumerate(("q1", "median", "q3"))])
    renamed = wide.select(*[F.col(b).alias(k) for b, k in keys.items()], "q1", "median", "q3")
    return summary.join(renamed, same).select(*by, "count", "low", "q1", "median", "q3", "high")


def clip_length(
    preds: DataFrame, formations: DataFrame, crop: DataFrame, named: Sequence[str] = OPEN_FORMATIONS
) -> DataFrame:
    """Distribution of clip length by formation, actual class and whether the call was right."""
    rows = with_clip_length(preds, formations, crop).where(F.col("formation").isin(*named))
    return five_numbers(rows.withColumn("match", F.col("actual") == call()), ["formation", "actual", "match"], "frames")


def histogram(df: DataFrame, by: Sequence[str], col: str, low: float, high: float, bins: int) -> DataFrame:
    """Rows per bin of ``col`` and their share of the group."""
    width = (high - low) / bins
    # The top edge belongs to the last bin.
    index = F.least(F.floor((F.col(col) - low) / width), F.lit(bins - 1)).cast("int")
    inside = df.where(F.col(col).between(low, high))
    counts = inside.groupBy(*by, index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", share("n", by))


def odds_by_coverage(preds: DataFrame, formations: DataFrame, bins: int = 20) -> DataFrame:
    """Distribution of the one-deep odds per formation, actual class and coverage."""
    rows = named_formation(with_formations(preds, formations)).where(F.col("formation").isin(*OPEN_FORMATIONS))
    return histogram(rows, ["formation", "actual", "pff_passcoverage"], "pred1", 0.0, 1.0, bins)


def play_search(
    preds: DataFrame,
    formations: DataFrame,
    crop: DataFrame,
    plays: DataFrame,
    predicate: Column,
    n: int | None = None,
    seed: int = 15,
) -> DataFrame:
    """Plays that meet a condition over prediction, formation, length, team and season."""
    teams = plays.select(*PLAY, "defensiveteam", "season")
    found = with_clip_length(preds, formations, crop).join(teams, list(PLAY), "left").where(predicate)
    return found if n is None else sample_rows(found, PLAY, n, seed)


def nth_play(df: DataFrame, order: Sequence[Column], n: int = 1, keys: Sequence[str] = PLAY) -> DataFrame:
    """The ``n``-th row in an order, equal values by key; runs as a top-n."""
    top = df.orderBy(*order, *keys).limit(n)
    place = Window.partitionBy(F.lit(0)).orderBy(*order, *keys)
    return top.withColumn("_n", F.row_number().over(place)).where(F.col("_n") == n).drop("_n")


def preds_long(wide: DataFrame, prefix: str = "pred") -> DataFrame:
    """One row per clip and class from columns named after the class.

    A file with a single unnamed class holds the odds of class 1.
    """
    lower = wide.toDF(*[c.lower() for c in wide.columns])
    odds = [c for c in lower.columns if prefix in c]
    long = lower.unpivot([c for c in lower.columns if c not in odds], odds, "_name", "odds")
    name = F.regexp_replace("_name", f"^.*?{prefix}", "")
    return long.withColumn("class", F.when(name == "", "1").otherwise(name)).select(
        "model", "date", "set", "clip_id", "class", "actual", "odds"
    )


def keep_extreme(df: DataFrame, by: Sequence[str], col: str, largest: bool = True) -> DataFrame:
    """Rows that hold the largest (smallest) value of their group, ties kept.

    For groups of a few rows, as the files and classes of a clip: one window,
    so that the input is read once and choices over equal keys share a shuffle.
    """
    edge = (F.max(col) if largest else F.min(col)).over(Window.partitionBy(*by))
    return df.withColumn("_edge", edge).where(F.col(col) == F.col("_edge")).drop("_edge")


def preds_latest(long: DataFrame) -> DataFrame:
    """Predictions of the newest file per model and clip."""
    return keep_extreme(long, ["model", "clip_id"], "date")


def preds_mapped(latest: DataFrame, mapping: DataFrame, subset: str = "assess", collapse: str = "both") -> DataFrame:
    """Likeliest class of every clip, with the coverage names of both labels.

    Equal odds keep a row per class. ``collapse`` says whether the long names
    are shortened in both columns, so that they can agree, or in the actual one only.
    """
    best = keep_extreme(latest.where(F.col("set") == subset), ["model", "clip_id"], "odds")
    names = mapping.select("model", "class", "coverages")
    actual = names.select("model", F.col("class").alias("actual"), F.col("coverages").alias("actual_coverage"))
    pred = names.select("model", "class", F.col("coverages").alias("pred_coverage"))
    joined = best.join(actual, ["model", "actual"], "left").join(pred, ["model", "class"], "left")

    def short(c):
        out = F
        for long_label, label in LONG_LABELS.items():
            out = out.when(F.col(c) == long_label, label)
        return out.otherwise(F.col(c))

    matched = joined.withColumn("match", F.col("actual_coverage") == F.col("pred_coverage"))
    cols = ["actual_coverage"] + (["pred_coverage"] if collapse == "both" else [])
    return matched.withColumns({c: short(c) for c in cols})


def pooled(mapped: DataFrame, whole: str = "all_class") -> DataFrame:
    """Give all models but the one-step model the name ``hierarchical``."""
    return mapped.withColumn("model", if_else(F.col("model") != whole, F.lit("hierarchical"), F.col("model")))


def confusion_long(mapped: DataFrame) -> DataFrame:
    """Confusion cells of the pooled models with their share of the actual class."""
    cells = mapped.groupBy("model", "actual_coverage", "pred_coverage").agg(F.count(F.lit(1)).alias("n"))
    return pooled(cells).withColumn("pct", share("n", ["model", "actual_coverage"]))


def model_comparison(mapped: DataFrame) -> DataFrame:
    """Accuracy of the one-step model against the hierarchical ones."""
    per_class = accuracy(pooled(mapped), ["model", "actual_coverage"], "actual_coverage", "pred_coverage")
    total = per_class.groupBy("model").agg(F.sum("count").alias("count"), F.sum("correct").alias("correct"))
    return total.withColumn("pct", F.try_divide(F.col("correct").cast("double"), F.col("count")))


def binary_outcome_class(preds: DataFrame, odds: str = "pred1", actual: str = "actual") -> DataFrame:
    """Name the four outcomes of a yes/no call: right either way, or wrong."""
    yes = F.col(odds) > 0.5
    truth = F.col(actual) == 1
    outcome = F.when(yes & truth, "1 High").when(~yes & ~truth, "2 High").when(yes != truth, "Wrong")
    return preds.withColumns({"pred_binary": yes.cast("int"), "class": outcome})


def split_accuracy_report(preds: DataFrame) -> DataFrame:
    """Accuracy per set and class as printable text; both fitting sets count as train."""
    merged = F.when(F.col("set").isin("ana", "assess"), "train").otherwise(F.col("set"))
    scored = accuracy(preds.withColumns({"pred": call(), "set": merged}), ["set", "actual"], rate="accuracy")
    return scored.select(
        "set",
        "actual",
        big_number("count").alias("count"),
        percent(F.round("accuracy", 3)).alias("accuracy"),
    )


def importance_report(importances: DataFrame) -> DataFrame:
    """Feature importances as printable text, blank where no deviation is known."""
    return importances.select(
        "category",
        scientific("importance_mean").alias("importance mean"),
        F.coalesce(scientific("importance_sd"), F.lit("")).alias("importance sd"),
    )


def scenario_curve(preds: DataFrame, distances: Sequence[int] = (5, 10, 15)) -> DataFrame:
    """Odds along the field per down and distance; of first downs only a few distances."""
    named = preds.withColumn("down", ordinal("down"))
    return named.where((F.col("down") != "1st") | F.col("yardstogo").isin(*distances))


def top_ranked(df: DataFrame, by: Sequence[str], col: str, n: int) -> DataFrame:
    """Rows ranked within the first ``n`` of their group, ties kept."""
    return df.withColumn("rk", min_rank(col, by, desc=True)).where(F.col("rk") <= n)
