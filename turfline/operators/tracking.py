"""Operators over tracking frames: crop, spot, rotate, average, rank, path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turfline.functions.columns import if_else, min_rank
from turfline.functions.lineage import cut_lineage
from turfline.functions.skew import HOT_ROWS, attach, has_hot, spread_rank

PLAY = ("gameid", "playid")
BALL = "football"
FIELD_WIDTH = 53.33
FIELD_LENGTH = 110.0

# Event names that start and end a play, and coverage labels.
SNAP_EVENTS = ("ball_snap", "autoevent_ballsnap", "snap_direct")
CLIP_EVENTS = (
    "pass_forward", "autoevent_passforward", "qb_sack", "run", "pass_outcome_incomplete", "pass_arrived",
    "autoevent_passinterrupted", "qb_strip_sack", "pass_tipped", "fumble", "pass_outcome_caught", "handoff",
    "pass_shovel", "qb_spike", "pass_outcome_interception", "lateral", "tackle", "fumble_defense_recovered",
    "fumble_offense_recovered", "qb_slide", "pass_outcome_touchdown", "dropped_pass", "safety",
)
COVERAGES = ("Cover-0", "Cover-1", "Cover-3", "Cover-2", "Quarters", "Cover-6")
SKILL_POSITIONS = ("WR", "FB", "TE", "RB")
GOAL_LINES = (10, 110, -10, -110)
BALL_COLOR = "#8d4d37"


def play_crop(
    track: DataFrame,
    snap_events: Sequence[str] = SNAP_EVENTS,
    clip_events: Sequence[str] = CLIP_EVENTS,
    keys: Sequence[str] = PLAY,
    frame: str = "frameid",
    event: str = "event",
    with_rows: bool = False,
) -> DataFrame:
    """First start frame and first end frame of every play that has either.

    One pass with a partial aggregate: a play of any size reaches the shuffle
    as one row per task. Without ``with_rows`` the event filter is pushed into
    the scan; with it every row is counted, which ``attach`` uses to find plays
    too large for one task.
    """
    starts, ends = F.col(event).isin(*snap_events), F.col(event).isin(*clip_events)
    aggs = [F.min(F.when(starts, F.col(frame))).alias("snap"), F.min(F.when(ends, F.col(frame))).alias("clip")]
    if with_rows:
        counted = track.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("n_rows"))
        return counted.where(F.col("snap").isNotNull() | F.col("clip").isNotNull())
    return track.where(F.col(event).isin(*snap_events, *clip_events)).groupBy(*keys).agg(*aggs)


def ball_spots(
    track: DataFrame,
    crop: DataFrame,
    keys: Sequence[str] = PLAY,
    frame: str = "frameid",
    ball: str = BALL,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Where the ball lies at the start frame."""
    at = crop.select(*keys, F.col("snap").alias("_snap"), *[c for c in crop.columns if c == "n_rows"])
    balls = track.where(F.col("team") == ball).select(*keys, frame, "x", "y")
    return attach(balls, at, keys, [frame], hot_rows=hot_rows, only=F.col(frame) == F.col("_snap")).select(
        *keys, F.col("x").alias("spot_x"), F.col("y").alias("spot_y")
    )


def clip_frames(
    track: DataFrame,
    crop: DataFrame,
    keys: Sequence[str] = PLAY,
    frame: str = "frameid",
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Frames from the start frame to the end frame, to the last one if there is no end.

    A play without a start keeps nothing, nor does one that ends before it starts.
    """
    bounds = crop.where(F.col("snap").isNotNull())
    within = (F.col(frame) >= F.col("snap")) & (F.col("clip").isNull() | (F.col(frame) <= F.col("clip")))
    return attach(track, bounds, keys, [frame], hot_rows=hot_rows, only=within)


def orient_coords(
    df: DataFrame, width: float = FIELD_WIDTH, length: float = FIELD_LENGTH, shift: bool = True
) -> DataFrame:
    """Turn coordinates so that every play runs the same way.

    Adds ``newx``, ``newy``, ``newo`` where x, y, o exist, and ``newspot_x``,
    ``newspot_y``, ``line_to_gain`` where the spot exists. With ``shift`` the
    own goal line becomes zero; without it only the rotation is done. A missing
    direction gives missing coordinates.
    """
    rightward = F.col("playdirection") == "right"
    sign = if_else(rightward, F.lit(-1.0), F.lit(1.0))
    origin = if_else(rightward, F.lit(length), F.lit(-10.0)) if shift else F.lit(0.0)

    def across(c):
        return if_else(rightward, F.col(c), F.lit(width) - F.col(c))

    def along(c):
        return sign * F.col(c)

    new = {}
    if "x" in df.columns:
        new |= {"newx": across("y"), "newy": along("x") + origin}
    if "o" in df.columns:
        new["newo"] = if_else(rightward, -(F.col("o") + 90), 90 - F.col("o"))
    if "spot_x" in df.columns:
        new |= {"newspot_x": across("spot_y"), "newspot_y": along("spot_x") + origin}
        if "yardstogo" in df.columns:
            new["line_to_gain"] = along("spot_x") - F.col("yardstogo") + origin
    return df.withColumns(new)


def relative_position(df: DataFrame, digits: int | None = 6) -> DataFrame:
    """Depth and width from the ball, and the distance to the first down.

    Rounded before any ranking, so that the order in which a mean was summed
    cannot decide a rank.
    """

    def r(c):
        return c if digits is None else F.round(c, digits)

    return df.withColumns(
        {
            "depth": r(F.col("newy") - F.col("newspot_y")),
            "width": r(F.col("newx") - F.col("newspot_x")),
            "first_down": r(F.col("line_to_gain") - F.col("newspot_y")),
        }
    )


def mean_positions(
    track: DataFrame,
    crop: DataFrame,
    plays: DataFrame,
    spots: DataFrame | None = None,
    keys: Sequence[str] = PLAY,
    frame: str = "frameid",
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Mean rotated position of each defender over the cropped frames.

    The frames meet one row per play and are summed as they are, by direction;
    rotation is linear, so it is done on the sums, a few rows per play. A
    missing coordinate or direction makes the mean missing. A player with two
    directions in a play has one mean and a row for the spot in each direction.
    Without ``spots`` the places of the ball at the start frame are taken. The
    sums, a few rows per play, meet them without being written, sorted or, for
    frames laid out by play, moved.
    """
    keys = list(keys)
    if not has_hot(crop, hot_rows):
        hot_rows = None
    facts = plays.select(*keys, "defensiveteam", "yardstogo")
    per_play = crop.where(F.col("snap").isNotNull()).join(facts, keys)
    narrow = track.select(*keys, frame, "nflid", "jerseynumber", "team", "playdirection", "x", "y")
    within = (F.col(frame) >= F.col("snap")) & (F.col("clip").isNull() | (F.col(frame) <= F.col("clip")))
    defends = within & (F.col("team") == F.col("defensiveteam"))
    if spots is None:
        # The ball's own row of the start frame gives the spot and is no defender's.
        defends = defends & ((F.col("team") != BALL) | (F.col(frame) != F.col("snap")))
        spots = ball_spots(track, crop, keys, frame, hot_rows=hot_rows).distinct()
    frames = attach(narrow, per_play, keys, [frame, "nflid"], hot_rows=hot_rows, only=defends)
    who = [*keys, "nflid", "jerseynumber"]
    right = F.col("playdirection") == "right"
    ways = {"right": right, "left": ~right, "none": F.col("playdirection").isNull()}
    aggs = [F.max("yardstogo").alias("yardstogo"), F.count("x").alias("_nx"), F.count("y").alias("_ny")]
    for way, here in ways.items():
        aggs += [F.count(F.when(here, 1)).alias(f"_{way}"), *[F.sum(F.when(here, F.col(c))).alias(f"_{way}_{c}") for c in ("x", "y")]]
    players = frames.groupBy(*who).agg(*aggs).join(spots.hint("shuffle_hash"), keys, "left")
    n = F.col("_right") + F.col("_left") + F.col("_none")
    def total(way, c):
        return F.when(F.col(f"_{way}") > 0, F.col(f"_{way}_new")[c] * F.col(f"_{way}")).otherwise(0.0)

    cells = ["newx", "newy", "newspot_y", "newspot_x", "line_to_gain"]
    both = players
    for way in ("right", "left"):
        both = orient_coords(
            both.withColumns({"playdirection": F.lit(way), **{c: F.col(f"_{way}_{c}") / F.nullif(F.col(f"_{way}"), F.lit(0)) for c in ("x", "y")}})
        ).withColumn(f"_{way}_new", F.struct(*cells)).drop(*cells)
    whole = (F.col("_none") == 0) & (F.col("_nx") == n) & (F.col("_ny") == n)
    mean = {c: F.when(whole, (total("right", c) + total("left", c)) / n) for c in ("newx", "newy")}
    unknown = F.struct(*[F.lit(None).cast("double").alias(c) for c in cells])
    seen = F.array_compact(
        F.array(F.when(F.col("_right") > 0, F.col("_right_new")), F.when(F.col("_left") > 0, F.col("_left_new")), F.when(F.col("_none") > 0, unknown))
    )
    return both.select(*who, *[v.alias(c) for c, v in mean.items()], F.explode(seen).alias("_way")).select(
        *who, *[F.col(f"_way.{c}").alias(c) for c in cells[2:]], "newx", "newy"
    )


def depth_by_play(
    positions: DataFrame,
    plays: DataFrame,
    coverages: Sequence[str] = COVERAGES,
    keys: Sequence[str] = PLAY,
    digits: int | None = 6,
    wide: bool = False,
) -> DataFrame:
    """Rank each play's defenders by depth and by width, for the chosen coverages.

    A play's defenders are ranked in one window, right as long as they fit one
    task; ``wide`` ranks plays of any size at the price of more shuffles.
    """
    labels = plays.where(F.col("pff_passcoverage").isin(*coverages)).select(*keys, "pff_passcoverage")
    placed = relative_position(positions.join(labels.hint("shuffle_hash"), list(keys)), digits).withColumn(
        "side", if_else(F.col("width") < 0, F.lit("L"), F.lit("R"))
    )
    if wide:
        return spread_rank(spread_rank(placed, keys, "width", "width_rk", desc=True), keys, "depth", "depth_rk")
    return placed.withColumns({"width_rk": min_rank("width", keys, desc=True), "depth_rk": min_rank("depth", keys)})


def play_frames(
    track: DataFrame,
    details: DataFrame,
    players: DataFrame,
    colors: DataFrame,
    keys: Sequence[str] = PLAY,
    frame: str = "frameid",
    snaps: DataFrame | None = None,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Frame table behind a play's moving picture, for all plays at once.

    The spot is where the ball lies one frame before ``ball_snap``. Plays
    without that frame are left out, as they have no spot to draw. All facts of
    a play, the two team colours included, meet in one row before the frames do.
    """
    keys = list(keys)
    if snaps is None:
        snaps = play_crop(track, ("ball_snap",), (), keys, frame, with_rows=True)
    before = snaps.withColumn("snap", F.col("snap") - 1)
    spots = ball_spots(track, before, keys, frame, hot_rows=hot_rows).select(*keys, F.col("spot_x").alias("spot"))
    # Two entries per play: one for each side.
    sides = colors.groupBy(*keys).agg(F.collect_list(F.struct("team", "color")).alias("_sides"))
    # Written: both sides of ``attach`` read it, and the planner goes by its size.
    per_play = cut_lineage(
        snaps.withColumnRenamed("snap", "ball_snap").drop("clip")
        .join(spots, keys)
        .join(details.select(*keys, "season", "yardstogo", "pff_passcoverage", "caption"), keys, "left")
        .join(sides, keys, "left")
    )
    is_ball = F.col("team") == BALL
    rightward = F.col("playdirection") == "right"
    own = F.filter("_sides", lambda s: s["team"] == F.col("team"))
    frames = (
        attach(track.drop("season"), per_play, keys, [frame, "nflid"], hot_rows=hot_rows)
        .withColumns({"color": F.get(own, F.lit(0))["color"], "o": F.coalesce("o", F.lit(0.0))})
        .drop("_sides")
        .join(players.select("nflid", "season", "position"), ["nflid", "season"], "left")
    )
    return orient_coords(frames, shift=False).withColumns(
        {
            "jerseynumber": F.when(~is_ball, F.col("jerseynumber")),
            "skill": F.when(F.col("position").isin(*SKILL_POSITIONS), "black"),
            "newspot": if_else(rightward, -F.col("spot"), F.col("spot")),
            "color": if_else(is_ball, F.lit(BALL_COLOR), F.col("color")),
            "shape": if_else(is_ball, F.lit(18), F.lit(19)),
        }
    ).withColumns(
        {
            "line_to_gain": F.col("newspot") - F.col("yardstogo"),
            "number_color": if_else(F.col("color") == "#FFFFFF", F.lit("black"), F.lit("white")),
        }
    )


def route_paths(frames: DataFrame, keys: Sequence[str] = PLAY, frame: str = "frameid") -> DataFrame:
    """Path of every skill player from the snap on, one row per point.

    The frame number orders the path; no path is gathered into an array, so its
    length is free.
    """
    return frames.where((F.col("skill") == "black") & (F.col(frame) >= F.col("ball_snap"))).select(
        *keys, "nflid", frame, "newx", "newy"
    )


def goal_lines_in_view(
    frames: DataFrame, lines: Sequence[float] = GOAL_LINES, keys: Sequence[str] = PLAY
) -> DataFrame:
    """Goal lines that fall inside the stretch of field a play covers."""
    spans = frames.groupBy(*keys).agg(F.min("newy").alias("low"), F.max("newy").alias("high"))
    each = F.explode(F.array(*[F.lit(float(v)) for v in lines])).alias("goal_line")
    return spans.select(*keys, "low", "high", each).where(F.col("goal_line").between(F.col("low"), F.col("high")))
