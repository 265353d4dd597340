"""Cropping, rotation, ranks and the join for oversized plays."""

import pytest
from pyspark.sql import functions as F

from turfline.functions.columns import min_rank
from turfline.functions.lineage import cut_lineage
from turfline.functions.skew import attach, spread_rank
from turfline.operators import tracking as tr

TRACK = (
    "gameid int, playid int, nflid bigint, frameid int, jerseynumber int, team string, playdirection string, "
    "x double, y double, o double, event string"
)
PLAYS = "gameid int, playid int, defensiveteam string, yardstogo int, pff_passcoverage string"


def frames(spark, play=1, direction="right", snap=2, clip=4, last=6, ball=(60.0, 20.0), events=True):
    """One play with the ball and two defenders; right and left plays are mirror images."""
    out = []
    for f in range(1, last + 1):
        event = "ball_snap" if f == snap else "pass_forward" if f == clip else None
        for n, (dx, dy, team) in enumerate([(0.0, 0.0, "football"), (5.0 + f, 3.0, "D"), (12.0, -4.0, "D"), (-1.0, 1.0, "O")]):
            x, y = ball[0] + dx, ball[1] + dy
            if direction == "left":
                x, y = 120.0 - x, 53.33 - y
            out.append((1, play, None if n == 0 else n, f, None if n == 0 else n, team, direction, x, y, 90.0, event))
    return spark.createDataFrame(out, TRACK)


@pytest.fixture
def plays(spark):
    return spark.createDataFrame([(1, p, "D", 10, "Cover-1") for p in (1, 2, 3)], PLAYS)


def depths(track, plays, **options):
    crop = tr.play_crop(track, with_rows=True)
    return tr.depth_by_play(tr.mean_positions(track, crop, plays, **options), plays)


def test_crop_needs_a_start_or_an_end(spark, rows):
    track = frames(spark).unionByName(frames(spark, 2, snap=0)).unionByName(frames(spark, 3, snap=0, clip=0))
    expected = [(1, 2, 4), (2, None, 4)]
    assert rows(tr.play_crop(track), "playid", "snap", "clip") == expected
    assert rows(tr.play_crop(track, with_rows=True), "playid", "snap", "clip", "n_rows") == [(*e, 24) for e in expected]


def test_clip_frames_edges(spark):
    def kept(**options):
        t = frames(spark, **options)
        return sorted({r["frameid"] for r in tr.clip_frames(t, tr.play_crop(t)).collect()})

    assert kept() == [2, 3, 4]
    assert kept(clip=0) == [2, 3, 4, 5, 6]
    assert kept(snap=5, clip=3) == []
    assert kept(snap=0) == []


def test_mirror_plays_have_equal_depth_and_width(spark, plays, rows):
    cols = ("nflid", "depth", "width", "first_down", "width_rk", "depth_rk", "side")
    right = rows(depths(frames(spark), plays), *cols)
    left = rows(depths(frames(spark, direction="left"), plays), *cols)
    assert right == left
    assert [(r[0], r[1], r[2]) for r in right] == [(1, -8.0, 3.0), (2, -12.0, -4.0)]


def test_missing_direction_gives_missing_coordinates(spark):
    got = tr.orient_coords(frames(spark).withColumn("playdirection", F.lit(None).cast("string"))).first()
    assert got["newx"] is None and got["newy"] is None and got["newo"] is None


def test_orientation_without_shift(spark):
    row = tr.orient_coords(frames(spark), shift=False).where("nflid = 2").first()
    assert (row["newx"], row["newy"], row["newo"]) == (16.0, -72.0, -180.0)


def test_spots_given_or_found_on_the_way(spark, plays, rows):
    track = frames(spark).unionByName(frames(spark, 2, "left")).unionByName(frames(spark, 3).where("team <> 'football'"))
    crop = tr.play_crop(track, with_rows=True)
    given = tr.mean_positions(track, crop, plays, tr.ball_spots(track, crop))
    found = tr.mean_positions(track, crop, plays)
    assert rows(given) == rows(found) and len(rows(found)) == 6
    assert rows(found.where("playid = 3"), "newspot_y") == [(None,), (None,)]


def test_a_ball_seen_twice_doubles_the_rows(spark, plays, rows):
    track = frames(spark)
    twice = track.unionByName(track.where("team = 'football'").withColumn("x", F.col("x") + 1))
    crop = tr.play_crop(twice)
    found = tr.mean_positions(twice, crop, plays)
    assert rows(found) == rows(tr.mean_positions(twice, crop, plays, tr.ball_spots(twice, crop)))
    assert found.count() == 4


@pytest.mark.parametrize("hot_rows", [None, 1, 10, 10_000])
def test_every_join_path_gives_the_same_result(spark, plays, rows, hot_rows):
    big = frames(spark, last=40, clip=35)
    track = big.unionByName(frames(spark, 2, "left")).unionByName(frames(spark, 3, clip=0))
    crop = tr.play_crop(track, with_rows=True)
    expected = rows(tr.mean_positions(track, crop.drop("n_rows"), plays))
    assert rows(tr.mean_positions(track, crop, plays, hot_rows=hot_rows)) == expected
    clipped = rows(tr.clip_frames(track, crop.drop("n_rows")), "playid", "frameid", "nflid")
    assert rows(tr.clip_frames(track, crop, hot_rows=hot_rows), "playid", "frameid", "nflid") == clipped


def test_hot_rows_are_spread_and_others_are_not(spark):
    rows_df = spark.range(2000).selectExpr("IF(id < 1500, 1, id) AS k", "id AS f")
    dim = rows_df.groupBy("k").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("v", F.col("k") * 2)
    out = attach(rows_df, dim, ["k"], ["f"], hot_rows=100)
    assert out.count() == 2000 and out.where("v <> k * 2").count() == 0
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in [line for line in plan.splitlines() if "Join LeftOuter" in line][0]


def test_frame_table(spark, plays):
    track = frames(spark)
    details = plays.withColumns({"season": F.lit(2018), "caption": F.lit("text")})
    players = spark.createDataFrame([(3, 2018, "WR"), (1, 2018, "CB")], "nflid bigint, season int, position string")
    colors = spark.createDataFrame([(1, 1, "D", "#FFFFFF"), (1, 1, "O", "#000000")], "gameid int, playid int, team string, color string")
    got = tr.play_frames(track, details, players, colors)
    assert got.count() == track.count()
    ball = got.where("team = 'football'").first()
    assert (ball["jerseynumber"], ball["shape"], ball["color"], ball["newspot"]) == (None, 18, tr.BALL_COLOR, -60.0)
    defender = got.where("nflid = 1").first()
    assert (defender["number_color"], defender["skill"], defender["line_to_gain"]) == ("black", None, -70.0)
    assert {r["color"] for r in got.where("team = 'O'").collect()} == {"#000000"}
    path = tr.route_paths(got)
    assert sorted(r["frameid"] for r in path.collect()) == [2, 3, 4, 5, 6]


def test_goal_lines(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 1, 60.0), (1, 2, -112.0), (1, 2, -109.0)], "gameid int, playid int, newy double")
    got = {(r["playid"], r["goal_line"]) for r in tr.goal_lines_in_view(df).collect()}
    assert got == {(1, 10.0), (2, -110.0)}


def test_ranks_run_from_one(warehouse):
    from turfline.plans import pipelines as pp

    d = pp.defender_depths(warehouse.track, warehouse.plays)
    per_play = d.groupBy("gameid", "playid").agg(F.min("depth_rk").alias("a"), F.max("depth_rk").alias("z"), F.count("*").alias("n"))
    assert per_play.where("a <> 1 OR z > n").count() == 0


@pytest.mark.parametrize("pieces", [1, 4, 256])
@pytest.mark.parametrize("desc", [False, True])
def test_spread_rank_equals_a_window(spark, pieces, desc):
    df = spark.range(3000).selectExpr(
        "IF(id % 3 = 0, 1, CAST(id % 50 AS INT)) AS g", "IF(id % 97 = 0, NULL, CAST(id * 7919 % 400 AS DOUBLE)) AS v"
    )
    got = spread_rank(df, ["g"], "v", "rk", desc, pieces)
    expected = df.withColumn("rk", min_rank("v", ["g"], desc))
    assert got.exceptAll(expected).count() == 0 and expected.exceptAll(got).count() == 0


def test_depths_of_oversized_plays(warehouse, rows):
    from turfline.plans import pipelines as pp

    cols = ("gameid", "playid", "nflid", "depth", "width", "width_rk", "depth_rk", "side")
    usual = rows(pp.defender_depths(warehouse.track, warehouse.plays), *cols)
    assert rows(pp.defender_depths(warehouse.track, warehouse.plays, hot_rows=100), *cols) == usual


def above_frames(df):
    """For each line of a plan that turns a frame into 23 rows: the operators from there to the first join by play, and to the top."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    names = [(len(line) - len(line.lstrip(" :+-*()0123456789")), line.lstrip(" :+-*()0123456789")) for line in lines]
    found = []
    for i, (depth, name) in enumerate(names):
        if name.startswith("Generate explode(org"):
            path = []
            for at, above in reversed(names[:i]):
                if at < depth:
                    depth = at
                    path.append(above.split(" ")[0])
            found.append((path[: path.index("ShuffledHashJoin")], path))
    return found


def test_frames_are_neither_moved_nor_sorted(spark, warehouse):
    """Also without broadcasts: only the thin lines that frames are made of are shuffled."""
    from turfline.plans import pipelines as pp

    w, moves = warehouse, {"Exchange", "Sort", "SortMergeJoin"}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        crop = cut_lineage(tr.play_crop(w.track, with_rows=True))
        for plan in (
            tr.clip_frames(w.track, crop),
            pp.frame_table(w.track, w.plays, w.games, w.players, w.color_grid),
            pp.alignments(w.track, w.plays, w.players),
        ):
            joins = above_frames(plan)
            assert joins and not any(moves & set(near) for near, _ in joins)
        means = above_frames(pp.defender_positions(w.track, w.plays))
        assert len(means) == 2 and not any(moves & set(path) for _, path in means)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64m")
