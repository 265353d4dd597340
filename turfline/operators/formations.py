"""Offensive alignment at the snap and the formation string derived from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turfline.functions.columns import avg_rank, if_else, share
from turfline.functions.lineage import cut_lineage
from turfline.functions.skew import attach
from turfline.operators.tracking import BALL, PLAY, orient_coords

ALIGNMENT_SNAPS = ("autoevent_ballsnap", "ball_snap")

# Common names of formation strings.
FORMATION_NAMES = {
    "3sx1s": "3x1 open", "2sx1c1s": "slot", "2sx2s": "2x2 open", "3sx2s": "empty open", "1sx1c2s": "trey",
    "2sx1s": "flex", "1sx1c1s": "pro", "2sx2c": "nub twins", "1s2cx1s": "trey", "2sx1c2s": "empty h",
    "1c1sx1c1s": "ace", "3sx0s1c": "nub trips", "2sx0s2c": "flank", "3sx1c": "nub trips", "1sx1s": "bone",
    "2sx1c": "twins", "3cx1s": "trips bunch",
}


def snap_places(
    track: DataFrame, snap_events: Sequence[str] = ALIGNMENT_SNAPS, keys: Sequence[str] = PLAY, frame: str = "frameid"
) -> DataFrame:
    """The ball's own first snap event of every play and its place then."""
    balls = track.where((F.col("team") == BALL) & F.col("event").isin(*snap_events))
    return balls.groupBy(*keys).agg(
        F.min(frame).alias(frame), F.min_by("x", frame).alias("spot_x"), F.min_by("y", frame).alias("spot_y")
    )


def alignment_by_play(
    track: DataFrame,
    plays: DataFrame,
    players: DataFrame,
    snaps: DataFrame | None = None,
    keys: Sequence[str] = PLAY,
    frame: str = "frameid",
) -> DataFrame:
    """Where each offensive player stands at the snap, seen from the ball.

    Snap frame, place of the ball and play facts meet in one row per play, past
    which the frames stream; frames laid out by play are not moved.
    """
    keys = list(keys)
    if snaps is None:
        snaps = snap_places(track, keys=keys, frame=frame)
    facts = plays.select(*keys, "defensiveteam", "yardstogo", "season")
    # Written, so that the planner knows how small it is.
    per_play = cut_lineage(snaps.withColumnRenamed(frame, "_at").join(facts, keys, "left"))
    narrow = track.select(*keys, frame, "nflid", "team", "playdirection", "x", "y").where(F.col("team") != BALL)
    offence = (
        attach(narrow, per_play, keys, [frame, "nflid"], only=(F.col(frame) == F.col("_at")) & (F.col("team") != F.col("defensiveteam")))
        .join(players.select("nflid", "season", "position"), ["nflid", "season"], "left")
    )
    placed = orient_coords(offence).withColumns(
        {
            "width": F.round(F.col("newx") - F.col("newspot_x"), 6),
            "depth": F.round(F.col("newy") - F.col("newspot_y"), 6),
        }
    )
    sideways = F.abs("width")
    return placed.select(
        *keys,
        "nflid",
        "position",
        "width",
        "depth",
        if_else(sideways < 1, F.lit("middle"), if_else(F.col("width") > 0, F.lit("right"), F.lit("left"))).alias(
            "alignment"
        ),
        ((F.col("depth") > 2) & (sideways < 5)).alias("backfield"),
    )


def alignment_sides(alignment: DataFrame, keys: Sequence[str] = PLAY) -> DataFrame:
    """One row per play: players on each side of the ball and behind it, and how far out they stand in all."""
    def here(side):
        return F.col("alignment") == side

    counts = [F.count(F.when(here(s), 1)).alias(s) for s in ("left", "middle", "right")]
    reach = [F.sum(F.when(here(s), F.abs("width"))).alias(f"{s}_reach") for s in ("left", "right")]
    return alignment.groupBy(*keys).agg(
        *counts, *reach, F.count(F.when(F.col("backfield"), 1)).alias("backs"), F.sum("depth").alias("depth")
    )


def formation_by_play(
    alignment: DataFrame,
    gap: float = 2.5,
    bunch_width: float = 6,
    n_eligible: int = 5,
    eligible: Sequence[str] = ("TE", "WR", "RB", "FB"),
    keys: Sequence[str] = PLAY,
) -> DataFrame:
    """Formation string of every play with exactly ``n_eligible`` eligible players.

    Gaps are measured between neighbours of one side, linemen included; a gap
    wider than ``gap`` starts a new group, and the group next to the ball is the
    core. Each side gives counts of core (c) and split (s) players, ``(bu)``
    marks a bunch; the sides are joined by ``x``, largest text first.

    The rows are clustered by play and sorted once: every window below asks for
    a clustering and an order that these already give, and the counts of both
    sides come from one aggregate per play.
    """
    keys = list(keys)
    group = [*keys, "alignment", "backfield"]
    outward = Window.partitionBy(*group).orderBy(F.asc_nulls_last("_away"), "nflid")
    so_far = outward.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gaps = (
        alignment.withColumn("_away", F.abs("width"))
        .repartition(*keys)
        .withColumns(
            {
                "split": F.col("_away") - F.lag("_away", 1, 0.0).over(outward),
                "split2": F.col("_away") - F.lag("_away", 2, 0.0).over(outward),
            }
        )
    )
    skilled = (
        gaps.where(F.col("position").isin(*eligible))
        .withColumns(
            {
                "horiz_group": F.sum((F.col("split") > gap).cast("int")).over(so_far) + 1,
                "width_rk": avg_rank("_away", group),
                "_players": F.count(F.lit(1)).over(Window.partitionBy(*keys)),
            }
        )
        .where(F.col("_players") == n_eligible)
    )
    front = ~F.col("backfield")
    flags = skilled.withColumns(
        {
            "core": (F.col("horiz_group") == 1) & front,
            "bunch": (F.col("split2") < bunch_width) & (F.col("width_rk") >= 3) & front,
        }
    )

    def total(cond):
        return F.sum(cond.cast("int"))

    groups = [(side, kind) for side in ("left", "right") for kind in ("c", "s")]
    counts = []
    for side, kind in groups:
        here = (F.col("alignment") == side) & (F.col("core") if kind == "c" else ~F.col("core"))
        counts += [
            total(here).alias(f"_{side}_{kind}"),
            total(here & front).alias(f"_{side}_{kind}_front"),
            total(here & F.col("bunch")).alias(f"_{side}_{kind}_bunch"),
        ]
    per_play = flags.groupBy(*keys).agg(
        total(F.col("core")).alias("core"),
        total(F.col("backfield")).alias("backs"),
        total(F.col("bunch")).alias("bunch"),
        *counts,
    )

    def mark(side, kind):
        return F.when(F.col(f"_{side}_{kind}_bunch") == 1, "(bu)").otherwise("")

    def flank(side, kind):
        text = F.concat(F.col(f"_{side}_{kind}_front").cast("string"), F.lit(kind), mark(side, kind))
        return F.when(F.col(f"_{side}_{kind}") > 0, text)

    def texts(side):
        """Core and split text of a side: one word if both carry the same mark."""
        c, s = flank(side, "c"), flank(side, "s")
        word = F.array(F.concat(F.least(c, s), F.greatest(c, s)))
        together = c.isNotNull() & s.isNotNull() & (mark(side, "c") == mark(side, "s"))
        return F.when(together, word).otherwise(F.array(c, s))

    sides = F.array_compact(F.concat(texts("left"), texts("right")))
    formation = F.array_join(F.sort_array(sides, asc=False), "x")
    return per_play.select(*keys, "core", "backs", "bunch", F.nullif(formation, F.lit("")).alias("formation"))


def formation_frequency(formations: DataFrame) -> DataFrame:
    """How often each formation occurs, its share and the running share.

    The whole-table window runs over the distinct formations, a small set: the
    counts of five players in a few groups.
    """
    counts = formations.groupBy("backs", "core", "bunch", "formation").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(F.lit(0)).orderBy(
        F.desc("n"), *[F.asc_nulls_last(c) for c in ("backs", "core", "bunch", "formation")]
    )
    running = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.withColumns({"pct": share("n", [F.lit(0)]), "cumu_pct": running / total})


def named_formation(df: DataFrame, names: dict[str, str] = FORMATION_NAMES) -> DataFrame:
    """Keep the code as ``id`` and put its common name, if it has one, in ``formation``."""
    rows = list(names.items())
    lookup = F.broadcast(df.sparkSession.createDataFrame(rows, "id string, _name string"))
    return (
        df.withColumnRenamed("formation", "id")
        .join(lookup, "id", "left")
        .withColumn("formation", F.coalesce("_name", "id"))
        .drop("_name")
    )
