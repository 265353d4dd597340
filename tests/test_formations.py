"""Formation strings on hand-made alignments."""

from turfline.operators import formations as fm

ALIGN = "gameid int, playid int, nflid int, position string, width double, depth double, alignment string, backfield boolean"


def play(spark, spec, playid=1):
    """``spec``: (position, width, backfield) per player."""
    rows = [
        (1, playid, i, pos, float(w), 4.0 if back else 1.0, "middle" if abs(w) < 1 else "right" if w > 0 else "left", back)
        for i, (pos, w, back) in enumerate(spec)
    ]
    return spark.createDataFrame(rows, ALIGN)


def code(df):
    r = fm.formation_by_play(df).first()
    return r and (r["formation"], r["core"], r["backs"], r["bunch"])


def test_gaps_count_linemen_too(spark):
    # Left: a lineman at 1.5 and an end at 3: no gap above 2.5, so the end is core.
    spec = [("OL", -1.5, False), ("TE", -3, False), ("WR", -20, False), ("WR", 20, False), ("WR", 12, False), ("RB", 0, True)]
    assert code(play(spark, spec)) == ("2sx1c1s", 1, 1, 0)


def test_gap_is_measured_from_the_ball(spark):
    spec = [("TE", -3, False), ("WR", -20, False), ("WR", 20, False), ("WR", 12, False), ("RB", 0, True)]
    assert code(play(spark, spec)) == ("2sx2s", 0, 1, 0)


def test_bunch_mark(spark):
    spec = [("WR", 10, False), ("WR", 12, False), ("WR", 14, False), ("WR", -10, False), ("RB", 0, True)]
    assert code(play(spark, spec)) == ("3s(bu)x1s", 0, 1, 1)


def test_backfield_side_counts_no_front(spark):
    spec = [("WR", 10, False), ("WR", 20, False), ("TE", 2, False), ("RB", -2, True), ("RB", 0.5, True)]
    assert code(play(spark, spec)) == ("1c2sx0s", 1, 2, 0)


def test_only_plays_with_five_eligible(spark):
    spec = [("WR", 10, False), ("WR", 20, False), ("TE", 2, False), ("RB", -2, True)]
    assert code(play(spark, spec)) is None
    assert code(play(spark, spec + [("OL", -1, False), ("OL", 1, False)])) is None


def test_no_one_outside_gives_no_text(spark):
    assert code(play(spark, [("RB", 0, True)] * 5)) == (None, 0, 5, 0)


def test_equal_widths_are_stable(spark):
    spec = [("WR", 10, False), ("WR", 10, False), ("WR", 20, False), ("WR", -10, False), ("RB", 0, True)]
    assert code(play(spark, spec)) == code(play(spark, spec)) == ("3sx1s", 0, 1, 0)


def test_names(spark):
    df = spark.createDataFrame([("2sx2s",), ("9sx9s",), (None,)], "formation string")
    got = {(r["id"], r["formation"]) for r in fm.named_formation(df).collect()}
    assert got == {("2sx2s", "2x2 open"), ("9sx9s", "9sx9s"), (None, None)}
    assert len(fm.FORMATION_NAMES) == 17


def test_frequency_ends_at_one(spark):
    df = play(spark, [("WR", 10, False), ("WR", 20, False), ("WR", -20, False), ("WR", -10, False), ("RB", 0, True)])
    got = fm.formation_frequency(fm.formation_by_play(df)).collect()
    assert got[0]["cumu_pct"] == 1.0 and got[0]["pct"] == 1.0


def test_one_shuffle_serves_all_windows(spark):
    df = play(spark, [("WR", 10, False)] * 5)
    plan = fm.formation_by_play(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def broadcasts(df):
    """The subtrees below every broadcast of a plan, as text."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(line) - len(line.lstrip(" :+-*0123456789()")) for line in lines]
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            yield "\n".join(lines[i:end])


def test_frames_are_never_broadcast(warehouse):
    from turfline.plans import pipelines as pp

    w = warehouse
    plans = [pp.alignments(w.track, w.plays, w.players), pp.formations(w.track, w.plays, w.players), pp.defender_positions(w.track, w.plays)]
    for df in plans:
        found = list(broadcasts(df))
        assert not [b for b in found if "l_linenumber" in b]
    assert list(broadcasts(plans[0]))  # the per-play table is


def test_sides_of_a_play(spark, rows):
    spec = [("WR", -10, False), ("WR", -4, False), ("TE", 3, False), ("QB", 0, True)]
    got = fm.alignment_sides(play(spark, spec))
    assert rows(got, "left", "middle", "right", "left_reach", "right_reach", "backs", "depth") == [(2, 1, 1, 14.0, 3.0, 1, 7.0)]
