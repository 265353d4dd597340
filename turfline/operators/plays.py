"""Play cleaning, captions and team colours; season unions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turfline.functions.columns import if_else, ordinal, paste, sub_first

SEASONS = (2018, 2021, 2022)

TRACKING_COLUMNS = (
    "gameid", "playid", "nflid", "frameid", "jerseynumber", "team", "playdirection",
    "x", "y", "s", "a", "dis", "o", "dir", "event",
)
PLAY_COLUMNS = (
    "gameid", "playid", "playdescription", "quarter", "down", "yardstogo", "possessionteam",
    "defensiveteam", "pff_passcoverage", "presnaphomescore", "presnapvisitorscore", "gameclock",
)


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; a column one part lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def tag_union(frames: dict, column: str) -> DataFrame:
    """Union whose rows carry the name of the part they came from."""
    return stack([df.withColumn(column, F.lit(tag)) for tag, df in frames.items()])


def unify_tracking(releases: Sequence[DataFrame]) -> DataFrame:
    """Bring the three tracking layouts to one; the newest names its team ``club``."""
    legs = []
    for df in releases:
        named = df.withColumnRenamed("club", "team") if "team" not in df.columns else df
        legs.append(named.select(*TRACKING_COLUMNS))
    return reduce(DataFrame.unionByName, legs)


def unify_games(by_season: dict[int, DataFrame]) -> DataFrame:
    """Games of all seasons.

    The first release has no season column and gets one. Of the last release
    the home score is left out and the visitor score kept, null elsewhere.
    """
    seasons = sorted(by_season)
    parts = []
    for s in seasons:
        df = by_season[s]
        if "season" not in df.columns:
            df = df.withColumn("season", F.lit(s))
        parts.append(df.drop("homefinalscore") if s == seasons[-1] else df)
    return stack(parts)


def unify_players(by_season: dict[int, DataFrame]) -> DataFrame:
    """Players of all seasons; the columns are named by position."""
    names = ("nflid", "height", "weight", "birthdate", "collegename", "position", "displayname")
    return stack([df.toDF(*names).withColumn("season", F.lit(s)) for s, df in sorted(by_season.items())])


def other_team(plays: DataFrame, games: DataFrame) -> DataFrame:
    """Add the defending team: whichever team of the game does not have the ball.

    A team that plays in neither role gives a row per team of the game, an
    unknown one gives two rows without a defence; a play of an unknown game is lost.
    """
    sides = games.select("gameid", F.array("hometeamabbr", "visitorteamabbr").alias("_sides"))
    unknown = F.transform("_sides", lambda _: F.lit(None).cast("string"))
    rest = F.filter("_sides", lambda t: t != F.col("possessionteam"))
    chosen = F.when(F.col("possessionteam").isNull(), unknown).otherwise(rest)
    return plays.join(sides, "gameid").withColumn("defensiveteam", F.explode(chosen)).drop("_sides")


def week_one_label(coverage) -> "F.Column":
    """Drop the last word, then join the first two words that remain with a dash."""
    return sub_first(sub_first(coverage, r" \w+$", ""), " ", "-")


def dropback_label(coverage) -> "F.Column":
    """``Cover 3 ...`` becomes ``Cover-3``; labels without ``Cover`` stay."""
    dashed = sub_first(coverage, "Cover ", "Cover-")
    return if_else(dashed.contains("Cover"), F.regexp_substr(dashed, F.lit(r"Cover-\d")), dashed)


def clean_plays(by_season: dict[int, DataFrame], games: DataFrame, coverages: DataFrame) -> DataFrame:
    """Plays of the three seasons with one set of columns and coverage labels.

    The oldest season lacks the defence and takes its labels from a file of its
    own; the newest keeps dropbacks only.
    """
    first, *middle, last = sorted(by_season)
    labels = coverages.select("gameid", "playid", week_one_label(F.col("coverage")).alias("pff_passcoverage"))
    parts = {
        first: other_team(by_season[first].drop("defensiveteam"), games)
        .drop("pff_passcoverage")
        .join(labels, ["gameid", "playid"])
    }
    parts |= {s: by_season[s] for s in middle}
    parts[last] = (
        by_season[last].where(F.col("isdropback"))
        .withColumn("pff_passcoverage", dropback_label(F.col("pff_passcoverage")))
    )
    return tag_union({s: df.select(*PLAY_COLUMNS) for s, df in parts.items()}, "season")


def play_details(plays: DataFrame, games: DataFrame) -> DataFrame:
    """Caption lines of every play: who at whom, clock, score, down and distance."""
    joined = plays.drop("season").join(games, "gameid", "left")

    def score(team):
        return if_else(F.col(team) == F.col("hometeamabbr"), F.col("presnaphomescore"), F.col("presnapvisitorscore"))

    where = if_else(F.col("possessionteam") == F.col("hometeamabbr"), F.lit("v"), F.lit("@"))
    clock = F.regexp_substr("gameclock", F.lit(r"\d+:\d+"))
    return (
        joined.withColumns(
            {"possessionteam_score": score("possessionteam"), "defensiveteam_score": score("defensiveteam")}
        )
        .withColumns(
            {
                "down_distance": paste(ordinal("down"), F.lit("&"), "yardstogo"),
                "scoreboard": paste("possessionteam_score", "defensiveteam_score", sep=" - "),
                "sitch": paste(ordinal("quarter"), F.lit("Quarter,"), clock),
                "location": paste("possessionteam", where, "defensiveteam", "gamedate"),
            }
        )
        .withColumn("caption", paste("location", "sitch", "scoreboard", "down_distance", sep="\n"))
    )


def team_colors(plays: DataFrame, color_grid: DataFrame) -> DataFrame:
    """Colour of each side in each play, one row per side.

    Both columns of a side travel in one struct, so the wide row is turned long
    once and nothing is joined back.
    """

    def code(c):
        return if_else(F.col(c) == "LAR", F.lit("LA"), F.col(c))

    grid = color_grid.select(
        code("team1").alias("possessionteam"),
        code("team2").alias("defensiveteam"),
        F.col("color1").alias("_c1"),
        F.col("color2").alias("_c2"),
    )
    sides = F.array(
        F.struct(F.col("possessionteam").alias("team"), F.col("_c1").alias("color")),
        F.struct(F.col("defensiveteam").alias("team"), F.col("_c2").alias("color")),
    )
    return (
        plays.select("gameid", "playid", "possessionteam", "defensiveteam")
        .join(grid, ["possessionteam", "defensiveteam"], "left")
        .select("gameid", "playid", F.explode(sides).alias("_s"))
        .select("gameid", "playid", "_s.team", "_s.color")
    )
