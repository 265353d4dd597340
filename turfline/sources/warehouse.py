"""Tracking-shaped tables derived from an order warehouse.

An order is a play, each distinct line number of it a frame, and every frame
holds the ball and 22 players. Whole tables are used, so the frames grow with
``lineitem``. Coordinates are multiples of 1/8, which sums exactly in any order.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a frame: the ball and 22 players.
PER_FRAME = 23


@dataclass
class Warehouse:
    """Lazy views over the Parquet files of one folder."""

    spark: SparkSession
    folder: str
    #: Parts that the frames are laid out in by play, such as the buckets of a table; the session's number if not given.
    parts: int | None = None

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def plays(self) -> DataFrame:
        facts = self.table("orders").select(
            F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), "o_totalprice", "o_orderdate", "o_orderpriority"
        )
        return facts.selectExpr(
            "2018000000 + k div 10 AS gameid",
            "k AS playid",
            "CASE k div 10 % 3 WHEN 0 THEN 2018 WHEN 1 THEN 2021 ELSE 2022 END AS season",
            "concat('Play ', k) AS playdescription",
            "1 + month(o_orderdate) % 4 AS quarter",
            "1 + CAST(substr(o_orderpriority, 1, 1) AS INT) % 4 AS down",
            "1 + CAST(floor(o_totalprice) AS BIGINT) % 15 AS yardstogo",
            "concat('T', IF(k % 4 < 2, k div 10 % 16, k div 10 % 16 + 16)) AS possessionteam",
            "concat('T', IF(k % 4 < 2, k div 10 % 16 + 16, k div 10 % 16)) AS defensiveteam",
            "element_at(array('Cover-0', 'Cover-1', 'Cover-2', 'Cover-3', 'Quarters', 'Cover-6', '2-Man'),"
            " CAST(1 + (k * 5 + c) % 7 AS INT)) AS pff_passcoverage",
            "k * 7 % 40 AS presnaphomescore",
            "k * 11 % 40 AS presnapvisitorscore",
            "concat(10 + k % 5, ':', 10 + k % 50, ':00') AS gameclock",
        )

    @cached_property
    def games(self) -> DataFrame:
        return self.plays.select("gameid", "season").distinct().selectExpr(
            "gameid",
            "season",
            "concat('T', (gameid - 2018000000) % 16) AS hometeamabbr",
            "concat('T', (gameid - 2018000000) % 16 + 16) AS visitorteamabbr",
            "concat('09/', 10 + gameid % 10, '/', season) AS gamedate",
        )

    @cached_property
    def players(self) -> DataFrame:
        """Three squads of 25 per season; in the last squad number 5 is a tight end."""
        return (
            self.table("nation")
            .select("n_nationkey", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("squad"))
            .select("*", F.explode(F.array(F.lit(2018), F.lit(2021), F.lit(2022))).alias("season"))
            .selectExpr(
                "CAST(100 + n_nationkey + 25 * squad AS BIGINT) AS nflid",
                "season",
                "CASE WHEN squad = 2 AND n_nationkey = 5 THEN 'TE' WHEN n_nationkey <= 5 THEN 'OL'"
                " WHEN n_nationkey = 6 THEN 'QB' WHEN n_nationkey IN (7, 8, 11) THEN 'WR'"
                " WHEN n_nationkey = 9 THEN 'TE' WHEN n_nationkey = 10 THEN 'RB' ELSE 'CB' END AS position",
            )
        )

    @cached_property
    def frames(self) -> DataFrame:
        """One row per order and line number; an event follows from the return flag.

        The flag is compared as a number, which keeps the aggregate hash-based.
        The lines are laid out by play while they are thin: what is derived
        from them keeps that layout, so that joins and sums by play move no
        frames, which are 23 times as many.
        """
        lines = self.table("lineitem").select(
            F.expr("2018000000 + l_orderkey div 10").alias("gameid"),
            F.col("l_orderkey").alias("playid"),
            F.col("l_linenumber").alias("f"),
            F.col("l_quantity").cast("bigint").alias("q"),
            F.ascii("l_returnflag").alias("flag"),
        )
        laid = lines.repartition(self.parts, "gameid", "playid") if self.parts else lines.repartition("gameid", "playid")
        return laid.groupBy("gameid", "playid", "f").agg(F.sum("q").alias("q"), F.max("flag").alias("flag"))

    @cached_property
    def track(self) -> DataFrame:
        """Ball and players of every frame; what they share is worked out once a frame."""
        entity = F.explode(F.sequence(F.lit(0), F.lit(PER_FRAME - 1))).alias("n")
        return (
            self.frames.select("*", F.col("playid").alias("k"))
            .selectExpr(
                "*",
                "IF(k % 2 = 0, 1, -1) AS sgn",
                "20 + k * 37 % 60 AS los",
                "concat('T', IF(k % 4 < 2, k div 10 % 16, k div 10 % 16 + 16)) AS attack",
                "concat('T', IF(k % 4 < 2, k div 10 % 16 + 16, k div 10 % 16)) AS defend",
                "IF(k % 2 = 0, 'right', 'left') AS playdirection",
                "CASE flag WHEN ascii('R') THEN IF(k % 3 = 0, 'autoevent_ballsnap', 'ball_snap')"
                " WHEN ascii('A') THEN IF(k % 5 = 0, 'qb_sack', 'pass_forward') ELSE IF(k % 2 = 0, 'line_set', NULL) END AS event",
            )
            .select("*", entity)
            .selectExpr(
                "gameid",
                "playid",
                "IF(n > 0, CAST(100 + n + 25 * (k % 3) AS BIGINT), NULL) AS nflid",
                "f AS frameid",
                "IF(n > 0, n, NULL) AS jerseynumber",
                "CASE WHEN n = 0 THEN 'football' WHEN n <= 11 THEN attack ELSE defend END AS team",
                "playdirection",
                "CASE WHEN n = 0 THEN los + CAST(f AS DOUBLE) / 8"
                " WHEN n <= 11 THEN los - sgn * CAST((k * 31 + n * 17) % 60 AS DOUBLE) / 8"
                " ELSE los + sgn * CAST((k * 31 + n * 53 + q * 3) % 220 - 20 AS DOUBLE) / 8 END AS x",
                "CASE WHEN n = 0 THEN 26.5D ELSE 1.5D + CAST((k * 13 + n * 97 + q) % 400 AS DOUBLE) / 8 END AS y",
                "IF(n = 0, NULL, CAST((k + n * 16) % 360 AS DOUBLE)) AS o",
                "event",
            )
        )

    @cached_property
    def color_grid(self) -> DataFrame:
        pairs = self.games.select("hometeamabbr", "visitorteamabbr").distinct()
        home = pairs.selectExpr("hometeamabbr AS team1", "visitorteamabbr AS team2", "'#FFFFFF' AS color1", "'#002244' AS color2")
        away = pairs.where("hometeamabbr <> 'T3'").selectExpr(
            "visitorteamabbr AS team1", "hometeamabbr AS team2", "'#AA0000' AS color1", "'#FFFFFF' AS color2"
        )
        return home.unionByName(away)

    @cached_property
    def preds(self) -> DataFrame:
        return self.plays.selectExpr(
            "gameid",
            "playid",
            "playid + 10000 AS clip_id",
            "pff_passcoverage",
            "IF(pff_passcoverage IN ('Cover-1', 'Cover-3'), '1-High', '2-High') AS actual",
            "CAST(playid * 7919 % 1009 AS DOUBLE) / 1009 AS pred1",
            "CAST(1009 - playid * 7919 % 1009 AS DOUBLE) / 1009 AS pred0",
            "CASE WHEN playid % 10 < 6 THEN 'ana' WHEN playid % 10 < 8 THEN 'assess' ELSE 'test' END AS `set`",
        )

    @cached_property
    def model_preds(self) -> DataFrame:
        """Wide odds of three models in two files each."""
        return (
            self.plays.select("playid", F.explode(F.array(*map(F.lit, ("all_class", "one_high", "two_high")))).alias("model"))
            .select("*", F.explode(F.array(F.lit("2025-02-01"), F.lit("2025-03-01"))).alias("day"))
            .selectExpr(
                "model",
                "to_date(day) AS date",
                "IF(playid % 4 = 0, 'test', 'assess') AS `set`",
                "playid + 10000 AS clip_id",
                "CAST(playid % 3 AS STRING) AS actual",
                "CAST((playid * 37 + day(date) * length(model) + month(date)) % 101 AS DOUBLE) AS pred0",
                "CAST((playid * 53 + length(model) * month(date)) % 101 AS DOUBLE) AS pred1",
                "CAST((playid * 71 + month(date)) % 101 AS DOUBLE) AS pred2",
            )
        )

    @cached_property
    def class_mapping(self) -> DataFrame:
        rows = [
            ("all_class", "0", "Cover-1"), ("all_class", "1", "Cover-3"), ("all_class", "2", "Quarters"),
            ("one_high", "0", "Cover-2; Quarters; Cover-6; 2-Man"), ("one_high", "1", "Cover-3; Cover-1"),
            ("two_high", "0", "Cover-3; Cover-1"), ("two_high", "1", "Cover-2"), ("two_high", "2", "Cover-6"),
        ]
        return self.spark.createDataFrame(rows, "model string, class string, coverages string")

    # Season releases in the layouts of the raw files.

    def tracking_releases(self) -> list[DataFrame]:
        full = self.track.selectExpr(
            "*", "x / 8 AS s", "y / 8 AS a", "(x + y) / 16 AS dis", "o / 2 AS dir", "(gameid - 2018000000) % 3 AS _release"
        )
        first, second, third = (full.where(F.col("_release") == i).drop("_release") for i in range(3))
        return [first.withColumn("route", F.lit("go")), second, third.withColumnRenamed("team", "club")]

    def games_by_season(self) -> dict[int, DataFrame]:
        def of(s):
            return self.games.where(F.col("season") == s)

        scored = of(2022).selectExpr("*", "gameid % 50 AS homefinalscore", "gameid % 41 AS visitorfinalscore")
        return {2018: of(2018).drop("season"), 2021: of(2021), 2022: scored}

    def plays_by_season(self) -> dict[int, DataFrame]:
        def of(s):
            return self.plays.where(F.col("season") == s).drop("season")

        lost = "IF(playid % 17 = 0, NULL, IF(playid % 19 = 0, 'T99', possessionteam)) AS possessionteam"
        keep = [c for c in self.plays.columns if c not in ("season", "possessionteam", "defensiveteam", "pff_passcoverage")]
        spaced = "replace(pff_passcoverage, '-', ' ') || IF(playid % 2 = 0, ' Left', '') AS pff_passcoverage"
        third = [c for c in self.plays.columns if c not in ("season", "pff_passcoverage")]
        return {
            2018: of(2018).selectExpr(*keep, lost),
            2021: of(2021),
            2022: of(2022).selectExpr(*third, spaced, "playid % 5 <> 0 AS isdropback"),
        }

    @property
    def week_one(self) -> DataFrame:
        first = self.plays.where(F.col("season") == 2018)
        return first.selectExpr("gameid", "playid", "replace(pff_passcoverage, '-', ' ') || ' Zone' AS coverage")

    def players_by_season(self) -> dict[int, DataFrame]:
        def of(s):
            return self.players.where(F.col("season") == s).selectExpr(
                "nflid AS id", "'6-2' AS h", "200 + nflid % 50 AS w", "'1995-01-01' AS b", "'State' AS c", "position AS p",
                "concat('Player ', nflid) AS d",
            )

        return {s: of(s) for s in (2018, 2021, 2022)}
