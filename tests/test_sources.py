"""Files written in the release layouts and read back."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from turfline.operators import tracking as tr
from turfline.sources import readers, sinks


def write(path, name, text):
    path.mkdir(parents=True, exist_ok=True)
    (path / name).write_text(text)
    return str(path / name)


def test_tracking_releases(spark, tmp_path, rows):
    a = write(tmp_path / "r1" / "weeks", "w1.csv",
              "time,x,y,s,a,dis,o,dir,event,nflId,displayName,jerseyNumber,position,frameId,team,gameId,playId,playDirection,route\n"
              "2018-09-07T01:07:14.599Z,1.5,2.5,0,0,0,NA,90,ball_snap,1,A B,5,WR,1,home,10,20,right,GO\n")
    b = write(tmp_path / "r2" / "weeks", "w1.csv",
              "gameId,playId,nflId,frameId,time,jerseyNumber,team,playDirection,x,y,s,a,dis,o,dir,event\n"
              "11,21,NA,1,2021-09-10T00:26:31.100,NA,football,left,3.5,4.5,0,0,0,NA,NA,None\n")
    c = write(tmp_path / "r3" / "weeks", "w1.csv",
              "gameId,playId,nflId,displayName,frameId,frameType,time,jerseyNumber,club,playDirection,x,y,s,a,dis,o,dir,event\n"
              "12,22,3,C D,1,BEFORE_SNAP,2022-09-08 20:24:05.200000,9,BUF,left,5.5,6.5,0,0,0,1,2,NA\n")
    track = readers.load_tracking(spark, {2018: a, 2021: b, 2022: c})
    assert len(track.columns) == 16 and "time" not in track.columns
    assert rows(track, "gameId", "nflId", "team", "x", "o", "event") == [
        (10, 1, "home", 1.5, None, "ball_snap"), (11, None, "football", 3.5, None, "None"), (12, 3, "BUF", 5.5, 1.0, None),
    ]


def test_one_season_has_its_own_layout(spark, tmp_path, rows):
    c = write(tmp_path / "r3" / "weeks", "w1.csv",
              "gameId,playId,nflId,displayName,frameId,frameType,time,jerseyNumber,club,playDirection,x,y,s,a,dis,o,dir,event\n"
              "12,22,3,C D,1,BEFORE_SNAP,2022-09-08 20:24:05.200000,9,BUF,left,5.5,6.5,0,0,0,1,2,NA\n")
    track = readers.load_tracking(spark, {2022: c})
    assert rows(track, "gameid", "team", "season") == [(12, "BUF", 2022)]
    with pytest.raises(Exception):
        readers.load_tracking(spark, {2021: c}).collect()
    sinks.write_tracking(track, str(tmp_path / "out"))
    assert rows(spark.read.parquet(str(tmp_path / "out")), "gameid", "season") == [(12, 2022)]


def test_another_column_order_stops_the_read(spark, tmp_path):
    a = write(tmp_path / "g", "a.csv", "gameId,home,visitor\n1,A,B\n")
    b = write(tmp_path / "g", "b.csv", "gameId,visitor,home\n2,D,C\n")
    assert readers.read_named(spark, a).count() == 1
    with pytest.raises(Exception):
        readers.read_named(spark, [a, b]).collect()


def test_quoted_header(spark, tmp_path):
    a = write(tmp_path, "q.csv", '"gameId","a, b"\n1,x\n')
    assert readers.header_of(spark, a) == ["gameId", "a, b"]


def test_files_inside_the_releases(spark, tmp_path):
    for season in (2018, 2021):
        write(tmp_path / str(season) / "weeks", "week2.csv", "x\n")
        write(tmp_path / str(season) / "weeks", "week1.csv", "x\n")
    releases = {s: str(tmp_path / str(s)) for s in (2018, 2021)}
    found = readers.find_files(spark, releases, "weeks/*.csv")
    assert [f.rsplit("/", 1)[-1] for f in found[2021]] == ["week1.csv", "week2.csv"]
    with pytest.raises(ValueError):
        readers.find_files(spark, releases, "games.csv")


def test_a_bad_number_stops_the_read(spark, tmp_path):
    path = write(tmp_path, "players.csv", "nflId,height,weight,birthDate,collegeName,position,displayName\nx1,6-2,200,1990,S,WR,A\n")
    with pytest.raises(Exception):
        readers.load_players(spark, {2018: path}).collect()


def test_games_players_and_plays(spark, tmp_path, rows):
    g1 = write(tmp_path / "1", "games.csv", "gameId,gameDate,homeTeamAbbr,visitorTeamAbbr\n1,09/06/2018,A,B\n")
    g2 = write(tmp_path / "2", "games.csv", "gameId,season,gameDate,homeTeamAbbr,visitorTeamAbbr\n2,2021,09/09/2021,C,D\n")
    g3 = write(tmp_path / "3", "games.csv", "gameId,season,gameDate,homeTeamAbbr,visitorTeamAbbr,homeFinalScore,visitorFinalScore\n3,2022,09/08/2022,E,F,10,31\n")
    games = readers.load_games(spark, {2018: g1, 2021: g2, 2022: g3})
    assert rows(games, "gameid", "season", "visitorfinalscore") == [(1, 2018, None), (2, 2021, None), (3, 2022, 31)]

    head = "gameId,playId,playDescription,quarter,down,yardsToGo,possessionTeam,preSnapHomeScore,preSnapVisitorScore,gameClock"
    p1 = write(tmp_path / "1", "plays.csv", head + "\n1,7,\"pass, short\",1,2,7,A,0,3,12:34:00\n1,8,run,1,2,7,A,0,3,12:34:00\n")
    p2 = write(tmp_path / "2", "plays.csv", head + ",defensiveTeam,pff_passCoverage\n2,7,x,1,2,7,C,0,3,12:34,D,Cover-6\n")
    p3 = write(tmp_path / "3", "plays.csv", head + ",defensiveTeam,pff_passCoverage,isDropback\n3,7,x,1,2,7,E,0,3,12:34,F,Cover 3 Zone,TRUE\n3,8,x,1,2,7,E,0,3,12:34,F,Quarters,FALSE\n")
    cov = write(tmp_path / "2", "coverages_week1.csv", "gameId,playId,coverage\n1,7,Cover 1 Man\n")
    plays = readers.load_plays(spark, {2018: p1, 2021: p2, 2022: p3}, games, cov)
    assert rows(plays, "gameid", "playid", "defensiveteam", "pff_passcoverage", "season", "playdescription") == [
        (1, 7, "B", "Cover-1", 2018, "pass, short"), (2, 7, "D", "Cover-6", 2021, "x"), (3, 7, "F", "Cover-3", 2022, "x"),
    ]

    body = "nflId,height,weight,birthDate,collegeName,position,displayName\n5,6-2,200,1990-01-01,S,WR,A B\n"
    q = [write(tmp_path / str(i), "players.csv", body) for i in (1, 2, 3)]
    players = readers.load_players(spark, dict(zip((2018, 2021, 2022), q)))
    assert rows(players, "nflid", "position", "season") == [(5, "WR", 2018), (5, "WR", 2021), (5, "WR", 2022)]


def test_release_folders_are_found_in_order(spark, tmp_path):
    for name in ("release-2022", "release-2019", "release-2023", "other"):
        (tmp_path / name).mkdir()
    found = readers.find_releases(spark, str(tmp_path), "release-*")
    assert [p.rsplit("/", 1)[-1] for p in found.values()] == ["release-2019", "release-2022", "release-2023"]
    with pytest.raises(ValueError):
        readers.find_releases(spark, str(tmp_path), "missing-*")


def test_model_files(spark, tmp_path, rows):
    a = write(tmp_path, "all_class_preds_20250301.csv", "SET,CLIP_ID,ACTUAL,PRED0,PRED1\nassess,1,0,0.25,0.75\n")
    b = write(tmp_path, "two_high_preds_20250215.csv", "set,clip_id,actual,pred\nassess,1,1,0.5\n")
    c = write(tmp_path, "hierarchy_preds_20250315.csv", "gameId,playId\n1,1\n")
    got = readers.read_model_predictions(spark, [a, b, c])
    assert [(r["model"], str(r["date"]), r["class"], r["odds"]) for r in got.orderBy("model", "class").collect()] == [
        ("all_class", "2025-03-01", "0", 0.25), ("all_class", "2025-03-01", "1", 0.75), ("two_high", "2025-02-15", "1", 0.5),
    ]
    m = write(tmp_path, "all_class_mapping.csv", "CLASS,coverages\n0,Cover-1\n")
    assert rows(readers.read_class_mapping(spark, m)) == [("0", "Cover-1", "all_class")]


def test_result_files(spark, tmp_path, rows):
    p = write(tmp_path, "preds.csv", "gameId,playId,clip_id,pff_passCoverage,actual,pred0,pred1,set\n1,1,5,Cover-1,1,0.2,0.8,ana\n1,2,6,Quarters,0,0.9,0.1,test\n")
    assert rows(readers.read_predictions(spark, p), "playid", "actual") == [(1, "1-High"), (2, "2-High")]
    i = write(tmp_path, "imp.csv", "category,importance_mean,importance_sd\na,0.5,NA\n")
    assert rows(readers.read_importances(spark, i)) == [("a", 0.5, None)]
    g = write(tmp_path, "grid.csv", "team1,team2,color1,color2\nLAR,B,#1,#2\n")
    assert rows(readers.read_color_grid(spark, g)) == [("LAR", "B", "#1", "#2")]
    s = write(tmp_path, "syn.csv", "DOWN,YARDSTOGO,SPOT_Y,pred1\n1,5,30,0.5\n")
    assert rows(readers.read_scenario_predictions(spark, s)) == [(1, 5, 30.0, 0.5)]


def test_formations_go_through_a_file(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, 1, 1, 1, 0, "2sx2s"), (1, 2, 0, 5, 0, None)], "gameid int, playid int, core bigint, backs bigint, bunch bigint, formation string")
    sinks.write_csv(df, str(tmp_path / "formations"))
    assert rows(readers.read_formations(spark, str(tmp_path / "formations"))) == rows(df)


def test_tracking_table_prunes_seasons(spark, tmp_path, warehouse):
    track = warehouse.track.join(warehouse.games.select("gameid", "season"), "gameid")
    sinks.write_tracking(track, str(tmp_path / "track"))
    back = spark.read.parquet(str(tmp_path / "track"))
    assert back.count() == track.count()
    plan = back.where("season = 2021 AND event = 'ball_snap'").select("playid")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season" in plan and "EqualTo(event,ball_snap)" in plan


def test_bucketed_tables_need_no_shuffle(spark, warehouse, rows):
    sinks.write_by_play(warehouse.track, "track_b", 4)
    sinks.write_by_play(warehouse.plays, "plays_b", 4)
    track, plays = spark.table("track_b"), spark.table("plays_b")
    crop = tr.play_crop(track)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        positions = tr.mean_positions(track, crop, plays, hot_rows=None)
        depths = tr.depth_by_play(positions, plays)
        assert "Exchange" not in depths._jdf.queryExecution().executedPlan().toString()
        assert depths.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64m")
        spark.sql("DROP TABLE track_b")
        spark.sql("DROP TABLE plays_b")


def test_stored_tables_prune_seasons_and_need_no_shuffle(spark, warehouse, rows):
    from turfline.plans import pipelines as pp
    from turfline.plans.registry import SEASON

    track = warehouse.track.withColumn("season", F.expr(SEASON))
    got = pp.season_extents(*pp.stored_by_play(track, warehouse.plays, 4), 2021)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SelectedBucketsCount: 4 out of 4" in plan
    scans = [line for line in plan.splitlines() if "FileScan" in line and "playdirection" not in line and "frameid" in line]
    assert scans and all("PartitionFilters: [isnotnull(season" in line for line in scans)
    assert rows(got) == rows(pp.season_extents(track, warehouse.plays, 2021)) and got.count() > 0


FRAME = {"gameid": "1", "playid": "2", "nflid": "3", "frameid": "4", "time": "2021-09-09T20:00:00", "jerseynumber": "9", "team": "A",
         "playdirection": "left", "x": "1.5", "y": "2.5", "s": "1", "a": "1", "dis": "1", "o": "NA", "dir": "1", "event": "NA"}


def frame_file(folder, name, lines, columns=None, spell=str):
    columns = columns or list(FRAME)
    body = [",".join(spell(c) for c in columns)] + [line if isinstance(line, str) else ",".join((FRAME | line)[c] for c in columns) for line in lines]
    return write(folder, name, "\n".join(body) + "\n")


def test_manifest_drives_the_load(spark, tmp_path):
    """Columns in another order, many files of a header, bad values, short lines and a file of another kind."""
    turned = list(FRAME)[::-1]
    files = [frame_file(tmp_path, f"week{i}.csv", [{"frameid": str(i)}, {"frameid": "x7"}], spell=str.upper) for i in range(4)]
    files += [frame_file(tmp_path, "other.csv", [{"frameid": "40"}, "1,2"], turned), write(tmp_path, "notes.csv", "gameId,note\n1,a\n2,b\n")]
    manifest = readers.release_manifest(spark, {2021: files})
    assert sorted((m["layout"] or 0, len(m["files"])) for m in manifest) == [(0, 1), (2021, 1), (2021, 4)]
    frames, rejects = readers.load_releases(spark, manifest)
    got = frames.orderBy("frameid").select("frameid", "x", "team", "o", "season").collect()
    assert [tuple(r) for r in got] == [(i, 1.5, "A", None, 2021) for i in (0, 1, 2, 3, 40)]
    left = sorted((r["file"].rsplit("/", 1)[-1], r["reason"], r["line"] and "x7" in r["line"]) for r in rejects.collect())
    assert left == [("notes.csv", "unknown header", None), ("other.csv", "value", False), *[(f"week{i}.csv", "value", True) for i in range(4)]]
    none, some = readers.load_releases(spark, [m for m in manifest if m["layout"] is None])
    assert none.count() == 0 and "season" in none.columns and some.count() == 1


def test_headers_of_many_files_are_one_leg_each(spark, tmp_path):
    wide = [write(tmp_path, f"m{i}_preds_2025030{i}.csv", "set,clip_id,actual,pred0,pred1\na,1,0,0.25,0.75\n") for i in range(1, 7)]
    one = write(tmp_path / "file=two_high_preds_20250215", "part-0.csv", "set,clip_id,actual,pred\na,1,1,0.5\n")
    got = readers.read_model_predictions(spark, [*wide, one])
    assert got._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 2
    found = sorted((r["model"], str(r["date"]), r["class"], r["odds"]) for r in got.collect())
    assert found == sorted([(f"m{i}", f"2025-03-0{i}", c, o) for i in range(1, 7) for c, o in (("0", 0.25), ("1", 0.75))] + [("two_high", "2025-02-15", "1", 0.5)])


def test_frames_laid_out_in_buckets_are_written_where_they_are(spark, small, rows):
    from turfline.plans import pipelines as pp
    from turfline.plans.registry import SEASON
    from turfline.sources.warehouse import Warehouse

    laid = Warehouse(spark, small, 5)
    plan = laid.track.repartition(5, "gameid", "playid")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    stored, _ = pp.stored_by_play(laid.track.withColumn("season", F.expr(SEASON)), laid.plays, 5)
    assert len(stored.inputFiles()) <= 5 * 3
    assert rows(stored.drop("season"), "playid", "frameid", "nflid", "x") == rows(laid.track, "playid", "frameid", "nflid", "x")


def test_buckets_grow_with_the_frames(spark):
    from turfline.plans import pipelines as pp

    assert pp.buckets_for(spark.range(10)) == 16
    assert pp.buckets_for(spark.range(100 * pp.BUCKET_ROWS + 1)) == 101


def test_packed_csv_is_found_and_read(spark, tmp_path, rows):
    df = spark.range(2000).selectExpr("CAST(id AS INT) AS gameid", "CAST(1 AS INT) AS playid", "repeat('Cover 3 Zone', 5) AS coverage")
    plain, packed = str(tmp_path / "plain"), str(tmp_path / "packed")
    sinks.write_csv(df.coalesce(1), plain)
    sinks.write_csv(df.coalesce(1), packed, "gzip")
    files = readers.find_files(spark, {2018: packed}, "*.csv.gz")[2018]
    assert rows(readers.read_named(spark, files)) == rows(df)
    size = {f: sum(p.stat().st_size for p in (tmp_path / f).glob("*.csv*")) for f in ("plain", "packed")}
    assert size["packed"] * 4 < size["plain"]


def test_all_cells_are_checked_whichever_are_used(spark, tmp_path):
    """Frames and rejects as one table, in another order of columns too, equal those that are written apart."""
    turned = list(FRAME)[::-1]
    files = [
        frame_file(tmp_path, "week1.csv", [{"frameid": "1"}, {"frameid": "x7"}, {"dir": "west"}, {"event": "snap", "x": "2.25"}, "1,2"]),
        frame_file(tmp_path, "week2.csv", [{"o": "north"}, {name: "NA" for name in FRAME}, {"x": "oops"}], turned), write(tmp_path, "notes.csv", "gameId,note\n1,a\n"),
    ]
    manifest = readers.release_manifest(spark, {2021: files})
    lines = readers.load_releases(spark, manifest, apart=False)
    counted = lines.groupBy("season", "reason").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("reason").isNull(), F.col("x"))).alias("x"))
    assert {(r["season"], r["reason"]): (r["n"], r["x"]) for r in counted.collect()} == {(2021, None): (3, 3.75), (2021, "value"): (5, None), (2021, "unknown header"): (1, None)}
    frames, rejects = readers.load_releases(spark, manifest)
    one = lines.where("reason IS NULL").select(*frames.columns)
    assert sorted(map(str, one.collect())) == sorted(map(str, frames.collect()))
    assert sorted(map(str, lines.where("reason IS NOT NULL").select(*rejects.columns).collect())) == sorted(map(str, rejects.collect()))
    nothing = readers.load_releases(spark, [m for m in manifest if m["layout"] is None], apart=False)
    assert [(r["season"], r["reason"], r["x"]) for r in nothing.collect()] == [(2021, "unknown header", None)]


def test_a_header_is_read_without_the_rest(spark, tmp_path):
    """A packed file that breaks off far behind its first line, and files as Spark reads them: marked, empty, with other line ends."""
    noise = random.Random(1)
    packed = gzip.compress(("\ufeffgameId,note\n" + "\n".join(str(noise.random()) for _ in range(200_000))).encode())
    (tmp_path / "a b.csv.gz").write_bytes(packed[: len(packed) // 2])
    files = [str(tmp_path / "a b.csv.gz"), write(tmp_path, "c.csv", "gameId,note\r\n1,2\r\n"), write(tmp_path, "d.csv", ""), write(tmp_path, "e.csv", "x")]
    found = readers.by_header(spark, files)
    assert {header: [f.rsplit("/", 1)[-1] for f in group] for header, group in found.items()} == {"gameId,note": ["a b.csv.gz", "c.csv"], "x": ["e.csv"]}


def test_release_load_goes_over_its_files_once(spark, small):
    """Whatever the session's parts, no file is long, and the sums read the files themselves with all their cells."""
    from turfline.plans import pipelines as pp
    from turfline.plans.registry import queries

    got = queries()["release_load"](spark, small)
    plan = got._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert len(scans) == 3 and all("FileScan csv" in line and "jerseynumber" in line for line in scans)
    assert pp.buckets_for(spark.range(10 * pp.BUCKET_ROWS), fold=3) == 30
