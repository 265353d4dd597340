"""Levels and field zones: summaries, bins, tiles and per-play counts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turfline.functions.columns import cut, if_else, min_rank, share, strict_mean, sub_first
from turfline.operators.tracking import PLAY

# Bin edges, bin labels and the limits of the drawn field.
X_BREAKS = (-50, -10, 10, 50)
Y_BREAKS = (-100, -20, -10, 0, 15)
X_LABELS = ("left third", "middle", "right third")
Y_LABELS = {5: ("real deep", "deep", "hooks", "blitz"), 6: ("real deep", "deep", "deep hooks", "shallow hooks", "blitz")}
X_LIMITS = (-20.0, 20.0)
Y_LIMITS = (-20.0, 5.0)
SYM_ZONES = ("blitz", "flat", "hooks", "middle", "third")


@dataclass(frozen=True)
class ZoneSpec:
    """Edges and labels of a zone grid: three columns by four or five rows."""

    x_breaks: Sequence[float] = X_BREAKS
    y_breaks: Sequence[float] = Y_BREAKS

    @property
    def y_labels(self) -> tuple[str, ...]:
        if len(self.x_breaks) != 4 or len(self.y_breaks) not in Y_LABELS:
            raise ValueError("a zone grid has 4 x breaks and 5 or 6 y breaks")
        return Y_LABELS[len(self.y_breaks)]

    def zone_of(self, x_label: str, y_label: str) -> str:
        if y_label == "blitz":
            return "blitz"
        hook = "hooks" in y_label
        if x_label == "middle":
            return "hooks" if hook else "middle"
        side = x_label.split(" ")[0]
        last_hook = [y for y in self.y_labels if "hooks" in y][-1]
        return f"flat_{side}" if y_label == last_hook else f"third_{side}"

    def xzone(self, value):
        return cut(value, self.x_breaks, X_LABELS)

    def yzone(self, value):
        return cut(value, self.y_breaks, self.y_labels)


def sym_zone(zone="zone"):
    """Zone name without its side."""
    return sub_first(zone, "_.+$", "")


def zone_dim(spark: SparkSession, spec: ZoneSpec = ZoneSpec()) -> DataFrame:
    """One row per bin with the zone it belongs to (12 or 15 rows)."""
    rows = [(x, y, spec.zone_of(x, y)) for x in X_LABELS for y in spec.y_labels]
    return spark.createDataFrame(rows, "xzone string, yzone string, zone string")


def with_zone(depths: DataFrame, spec: ZoneSpec = ZoneSpec()) -> DataFrame:
    """Add bin and zone; a point outside the grid keeps a null zone.

    The grid has at most 15 rows, so its side of the join is broadcast.
    """
    binned = depths.withColumns({"xzone": spec.xzone("width"), "yzone": spec.yzone("depth")})
    grid = F.broadcast(zone_dim(depths.sparkSession, spec))
    return binned.join(grid, ["xzone", "yzone"], "left").withColumn("sym_zone", sym_zone())


def first_by_key(df: DataFrame, by: Sequence[str], count: str, keys: Sequence[str], n: int) -> DataFrame:
    """Rows among the ``n`` largest counts of their group, then the first ``n`` in key order."""
    ranked = df.withColumn("rk", min_rank(count, by, desc=True)).where(F.col("rk") <= n)
    order = Window.partitionBy(*by).orderBy(*[F.asc_nulls_last(k) for k in keys])
    return ranked.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def deepest(depths: DataFrame, n: int, keys: Sequence[str] = PLAY) -> DataFrame:
    """The ``n`` deepest defenders of every play, ties kept; a depth rank that is there already is used."""
    if "depth_rk" in depths.columns:
        return depths.where(F.col("depth_rk") <= n)
    return depths.withColumn("depth_rk", min_rank("depth", keys)).where(F.col("depth_rk") <= n)


def _profile(df: DataFrame, by: Sequence[str], means: Sequence[str] = ("depth", "width")) -> DataFrame:
    """Counts and means; a missing input makes a mean missing."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("count"), *[strict_mean(c).alias(c) for c in means])


def depth_by_level(depths: DataFrame, n: int = 7, cut_at: float = -15, keys: Sequence[str] = PLAY) -> DataFrame:
    """Mean place per coverage, level (1 near, 2 deep, none without a depth) and left-to-right rank in the level."""
    levels = deepest(depths, n, keys).withColumn("level", if_else(F.col("depth") < cut_at, F.lit(2), F.lit(1)))
    ranked = levels.withColumn("width_rk", min_rank("width", [*keys, "level"]))
    return _profile(ranked, ["pff_passcoverage", "level", "width_rk"])


def level_leaders(by_level: DataFrame, n: int = 11) -> DataFrame:
    """The commonest level and rank pairs of each coverage."""
    return first_by_key(by_level, ["pff_passcoverage"], "count", ["level", "width_rk"], n)


def zone_profile(
    depths: DataFrame, spec: ZoneSpec = ZoneSpec(), n: int = 7, keys: Sequence[str] = PLAY
) -> DataFrame:
    """Mean place per coverage, zone and left-to-right rank in the zone."""
    ranked = with_zone(deepest(depths, n, keys), spec).withColumn(
        "width_rk", min_rank("width", [*keys, "zone", "sym_zone"])
    )
    return _profile(ranked, ["pff_passcoverage", "zone", "sym_zone", "width_rk"])


def depth_by_zone(
    depths: DataFrame, spec: ZoneSpec = ZoneSpec(), n: int = 7, keys: Sequence[str] = PLAY
) -> DataFrame:
    """The ``n`` commonest zone spots of each coverage and their share of its plays."""
    top = first_by_key(
        zone_profile(depths, spec, n, keys), ["pff_passcoverage"], "count", ["zone", "sym_zone", "width_rk"], n
    )
    return top.withColumn("pct", share("count", ["pff_passcoverage"]))


def zone_grid_counts(depths: DataFrame, spec: ZoneSpec = ZoneSpec()) -> DataFrame:
    """Every bin of the grid with the number of defenders seen in it."""
    binned = depths.select(spec.xzone("width").alias("xzone"), spec.yzone("depth").alias("yzone"))
    seen = binned.groupBy("xzone", "yzone").agg(F.count(F.lit(1)).alias("count"))
    grid = zone_dim(depths.sparkSession, spec)
    return (
        grid.join(seen, ["xzone", "yzone"], "left")
        .withColumn("count", F.coalesce("count", F.lit(0)))
        .withColumn("sym_zone", sym_zone())
    )


def zone_tiles(
    spark: SparkSession,
    spec: ZoneSpec = ZoneSpec(),
    x_limits: Sequence[float] = X_LIMITS,
    y_limits: Sequence[float] = Y_LIMITS,
) -> DataFrame:
    """Rectangles of the grid, clamped to the drawn field: centre, size and zone."""

    def clamp(breaks, limits):
        return F.array_distinct(F.array(*[F.lit(float(min(max(b, limits[0]), limits[1]))) for b in sorted(breaks)]))

    grid = (
        spark.range(1)
        .select(F.explode(clamp(spec.x_breaks, x_limits)).alias("x_edge"))
        .select("x_edge", F.explode(clamp(spec.y_breaks, y_limits)).alias("y_edge"))
    )
    columns, rows = Window.partitionBy("x_edge").orderBy("y_edge"), Window.partitionBy("y_edge").orderBy("x_edge")
    sized = (
        grid.withColumns({"y_lead": F.lead("y_edge").over(columns), "x_lead": F.lead("x_edge").over(rows)})
        .where(F.col("x_lead").isNotNull() & F.col("y_lead").isNotNull())
        .withColumns({"x": (F.col("x_edge") + F.col("x_lead")) / 2, "y": (F.col("y_edge") + F.col("y_lead")) / 2})
        .withColumns({"w": F.abs(F.col("x_edge") - F.col("x")) * 2, "h": F.abs(F.col("y_edge") - F.col("y")) * 2})
        .withColumns({"xzone": spec.xzone("x"), "yzone": spec.yzone("y")})
    )
    return (
        sized.join(F.broadcast(zone_dim(spark, spec)), ["xzone", "yzone"], "left")
        .withColumn("sym_zone", sym_zone())
        .select("x", "y", "w", "h", "xzone", "yzone", "zone", "sym_zone")
    )


def zone_heatmap(
    points: DataFrame,
    spec: ZoneSpec = ZoneSpec(),
    x_limits: Sequence[float] = X_LIMITS,
    y_limits: Sequence[float] = Y_LIMITS,
) -> DataFrame:
    """Points per drawn tile. Points are counted per bin before they meet the tiles."""
    tiles = zone_tiles(points.sparkSession, spec, x_limits, y_limits)
    counts = zone_grid_counts(points, spec).select("xzone", "yzone", "count")
    return tiles.join(counts, ["xzone", "yzone"], "left").withColumn("count", F.coalesce("count", F.lit(0)))


def zone_counts_by_play(
    depths: DataFrame, spec: ZoneSpec = ZoneSpec(), n: int = 7, keys: Sequence[str] = PLAY
) -> DataFrame:
    """How many of a play's deepest defenders stand in each zone."""
    return (
        with_zone(deepest(depths, n, keys), spec)
        .groupBy(*keys, "pff_passcoverage", "zone", "sym_zone")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def zone_usage(counts: DataFrame, keys: Sequence[str] = PLAY) -> DataFrame:
    """Plays that use a kind of zone, and the mean number of defenders in it, by coverage."""
    return counts.groupBy("pff_passcoverage", "sym_zone").agg(
        F.count_distinct(*keys).alias("plays"), F.avg("count").alias("count")
    )


def zone_features(
    counts: DataFrame,
    zones: Sequence[str] = SYM_ZONES,
    one_high: Sequence[str] = ("Cover-3", "Cover-1"),
    keys: Sequence[str] = PLAY,
) -> DataFrame:
    """One row per play: defenders by kind of zone, and whether one or two play deep."""
    wide = (
        counts.groupBy(*keys, "pff_passcoverage").pivot("sym_zone", list(zones)).agg(F.sum("count")).na.fill(0, list(zones))
    )
    return wide.withColumn("hierarchy", F.col("pff_passcoverage").isin(*one_high).cast("int"))


def deepest_players(
    depths: DataFrame,
    ranks: Sequence[int] = (1, 2),
    centerfield: bool = False,
    wide: bool = False,
    keys: Sequence[str] = PLAY,
) -> DataFrame:
    """Spread of a play's deepest defenders: depth range, largest width and, on request,
    how many stand in centre field and the mean width of all but the leftmost."""
    by = [*keys, "pff_passcoverage"]
    chosen = depths.where(F.col("depth_rk").isin(*ranks))
    aggs = [
        F.round(F.max("depth") - F.min("depth"), 6).alias("depth_diff"),
        F.max(F.abs("width")).alias("max_width"),
    ]
    if centerfield:
        middle = (F.col("depth") <= -15) & (F.abs("width") < 5)
        aggs.append(F.sum(middle.cast("int")).alias("centerfielders"))
    if wide:
        # The window and the aggregate cluster by the same columns: one shuffle.
        chosen = chosen.withColumn("_left", F.min("width").over(Window.partitionBy(*by)))
        rest = F.when(F.col("width") != F.col("_left"), F.col("width"))
        aggs.append(F.avg(rest).alias("wide_width"))
    return chosen.groupBy(*by).agg(*aggs)


def spread_by_coverage(players: DataFrame) -> DataFrame:
    """Mean spread of the deepest defenders by coverage."""
    return _profile(players, ["pff_passcoverage"], ["depth_diff", "max_width"])


def side_profile(depths: DataFrame) -> DataFrame:
    """Mean place by coverage, side and depth rank."""
    return _profile(depths, ["pff_passcoverage", "side", "depth_rk"], ["width", "depth"]).drop("count")


def shallow_profile(depths: DataFrame, from_rank: int = 5) -> DataFrame:
    """Mean place by coverage and width rank of the shallower defenders."""
    near = depths.where(F.col("depth_rk") >= from_rank)
    return _profile(near, ["pff_passcoverage", "width_rk"], ["width", "depth"]).drop("count")


def rank_profile(depths: DataFrame, n: int = 7) -> DataFrame:
    """Mean place by coverage and both ranks, with the pair of ranks as a label."""
    out = _profile(
        depths.where(F.col("depth_rk") <= n), ["pff_passcoverage", "width_rk", "depth_rk"], ["width", "depth", "first_down"]
    )
    return out.withColumn("pos", F.concat_ws("-", "depth_rk", "width_rk"))
