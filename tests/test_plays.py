"""Cleaning rules and captions on hand-made rows."""

from pyspark.sql import functions as F

from turfline.operators import plays as pl


def test_coverage_labels(spark):
    df = spark.createDataFrame([("Cover 3 Zone",), ("X Zone",), ("Cover 2 Man",), ("Man",)], "c string")
    assert [r[0] for r in df.select(pl.week_one_label(F.col("c"))).collect()] == ["Cover-3", "X", "Cover-2", "Man"]
    df = spark.createDataFrame([("Cover 3 Zone",), ("Cover-3 Seam",), ("Quarters",), ("Cover Zero",), (None,)], "c string")
    assert [r[0] for r in df.select(pl.dropback_label(F.col("c"))).collect()] == ["Cover-3", "Cover-3", "Quarters", None, None]


def test_other_team(spark, rows):
    games = spark.createDataFrame([(1, "A", "B")], "gameid int, hometeamabbr string, visitorteamabbr string")
    plays = spark.createDataFrame(
        [(1, 1, "A"), (1, 2, "B"), (1, 3, "X"), (1, 4, None), (2, 5, "A")], "gameid int, playid int, possessionteam string"
    )
    got = rows(pl.other_team(plays, games), "playid", "defensiveteam")
    assert got == [(1, "B"), (2, "A"), (3, "A"), (3, "B"), (4, None), (4, None)]


def test_games_union_keeps_the_visitor_score(spark):
    a = spark.createDataFrame([(1,)], "gameid int")
    b = spark.createDataFrame([(2, 2021)], "gameid int, season int")
    c = spark.createDataFrame([(3, 2022, 10, 7)], "gameid int, season int, homefinalscore int, visitorfinalscore int")
    got = pl.unify_games({2018: a, 2021: b, 2022: c})
    assert set(got.columns) == {"gameid", "season", "visitorfinalscore"}
    assert {(r["gameid"], r["season"], r["visitorfinalscore"]) for r in got.collect()} == {(1, 2018, None), (2, 2021, None), (3, 2022, 7)}


def test_caption(spark):
    plays = spark.createDataFrame(
        [(1, 1, 2018, "B", "A", 3, 2, 7, 14, 10, "12:34:00", "Cover-1")],
        "gameid int, playid int, season int, possessionteam string, defensiveteam string, quarter int, down int, yardstogo int,"
        "presnaphomescore int, presnapvisitorscore int, gameclock string, pff_passcoverage string",
    )
    games = spark.createDataFrame([(1, 2018, "A", "B", "09/10/2018")], "gameid int, season int, hometeamabbr string, visitorteamabbr string, gamedate string")
    got = pl.play_details(plays, games).first()["caption"]
    assert got == "B @ A 09/10/2018\n3rd Quarter, 12:34\n10 - 14\n2nd & 7"
    lost = pl.play_details(plays, games.where("gameid = 9")).first()["caption"]
    assert lost == "B NA A NA\n3rd Quarter, 12:34\nNA - NA\n2nd & 7"


def test_team_colors_use_the_old_code(spark, rows):
    plays = spark.createDataFrame([(1, 1, "LA", "B"), (1, 2, "C", "B")], "gameid int, playid int, possessionteam string, defensiveteam string")
    grid = spark.createDataFrame([("LAR", "B", "#1", "#2")], "team1 string, team2 string, color1 string, color2 string")
    got = rows(pl.team_colors(plays, grid), "playid", "team", "color")
    assert got == [(1, "B", "#2"), (1, "LA", "#1"), (2, "B", None), (2, "C", None)]
