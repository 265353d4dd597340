"""Zone grids and summaries."""

import pytest

from turfline.operators import zones as zn

DEPTHS = "gameid int, playid int, nflid int, pff_passcoverage string, depth double, width double, depth_rk int, width_rk int"


@pytest.fixture
def depths(spark):
    rows = [
        (1, 1, 1, "Cover-1", -25.0, -20.0, 1, 3),
        (1, 1, 2, "Cover-1", -15.0, 0.0, 2, 2),
        (1, 1, 3, "Cover-1", -5.0, 20.0, 3, 1),
        (1, 2, 1, "Cover-2", 3.0, 60.0, 2, 1),
        (1, 2, 2, "Cover-2", -12.0, 4.0, 1, 2),
    ]
    return spark.createDataFrame(rows, DEPTHS)


def test_grid_of_five_breaks(spark, rows):
    got = {(r["xzone"], r["yzone"]): r["zone"] for r in zn.zone_dim(spark).collect()}
    assert len(got) == 12
    assert got["left third", "real deep"] == got["left third", "deep"] == "third_left"
    assert got["left third", "hooks"] == "flat_left" and got["middle", "hooks"] == "hooks"
    assert got["middle", "deep"] == "middle" and got["right third", "blitz"] == "blitz"


def test_grid_of_six_breaks(spark):
    spec = zn.ZoneSpec(y_breaks=(-100, -20, -15, -10, 0, 15))
    got = {(r["xzone"], r["yzone"]): r["zone"] for r in zn.zone_dim(spark, spec).collect()}
    assert len(got) == 15
    assert [got["right third", y] for y in spec.y_labels] == ["third_right"] * 3 + ["flat_right", "blitz"]
    assert [got["middle", y] for y in spec.y_labels] == ["middle", "middle", "hooks", "hooks", "blitz"]


def test_wrong_breaks_are_refused(spark):
    with pytest.raises(ValueError):
        zn.zone_dim(spark, zn.ZoneSpec(y_breaks=(0, 1)))


def test_points_outside_keep_a_null_zone(depths, rows):
    got = rows(zn.with_zone(depths), "playid", "nflid", "zone", "sym_zone")
    assert got == [
        (1, 1, "third_left", "third"), (1, 2, "middle", "middle"), (1, 3, "flat_right", "flat"),
        (2, 1, None, None), (2, 2, "middle", "middle"),
    ]


def test_tiles_are_clamped(spark, rows):
    got = rows(zn.zone_tiles(spark), "x", "y", "w", "h")
    assert len(got) == 9
    assert (0.0, 2.5, 20.0, 5.0) in got and (-15.0, -15.0, 10.0, 10.0) in got


def test_features_and_usage(depths, rows):
    counts = zn.zone_counts_by_play(depths)
    got = rows(zn.zone_features(counts), "playid", "blitz", "flat", "hooks", "middle", "third", "hierarchy")
    assert got == [(1, 0, 1, 0, 1, 1, 1), (2, 0, 0, 0, 1, 0, 0)]
    usage = {(r["pff_passcoverage"], r["sym_zone"]): (r["plays"], r["count"]) for r in zn.zone_usage(counts).collect()}
    assert usage["Cover-1", "third"] == (1, 1.0)


def test_top_rows_follow_key_order(spark, rows):
    df = spark.createDataFrame([("a", "z1", 5), ("a", "z2", 3), ("a", "z3", 3), ("a", "z4", 1)], "c string, zone string, n int")
    assert rows(zn.first_by_key(df, ["c"], "n", ["zone"], 2), "zone", "rk") == [("z1", 1), ("z2", 2)]
    late = spark.createDataFrame([("a", "z3", 5), ("a", "z2", 3), ("a", "z1", 3)], "c string, zone string, n int")
    assert rows(zn.first_by_key(late, ["c"], "n", ["zone"], 2), "zone", "rk") == [("z1", 2), ("z2", 2)]


def test_spread_of_the_deepest(depths, rows):
    got = rows(zn.deepest_players(depths, ranks=(1, 2, 3), centerfield=True, wide=True))
    assert got == [(1, 1, "Cover-1", 20.0, 20.0, 1, 10.0), (1, 2, "Cover-2", 15.0, 60.0, 0, 60.0)]


def test_mean_of_the_rest_is_null_if_all_tie(spark, rows):
    df = spark.createDataFrame([(1, 1, i, "Cover-1", -1.0, 2.0, 1, 1) for i in range(3)], DEPTHS)
    assert rows(zn.deepest_players(df, wide=True), "wide_width") == [(None,)]


def test_zone_shares_sum_to_one(depths):
    got = zn.depth_by_zone(depths).groupBy("pff_passcoverage").sum("pct").collect()
    assert all(abs(r[1] - 1) < 1e-12 for r in got)
