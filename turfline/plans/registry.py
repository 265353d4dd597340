"""Named queries over the order warehouse (see ``turfline.sources.warehouse``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turfline.functions.columns import yard_label
from turfline.functions.lineage import cut_lineage, scratch
from turfline.functions.sampling import kfold, sample_rows, zscore
from turfline.operators import formations as fm
from turfline.operators import grids as gr
from turfline.operators import logistic as lg
from turfline.operators import neighbours as nn
from turfline.operators import plays as pl
from turfline.operators import scoring as sc
from turfline.operators import tracking as tr
from turfline.operators import zones as zn
from turfline.plans import pipelines as pp
from turfline.sources import readers, sinks
from turfline.sources.warehouse import PER_FRAME, Warehouse

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

FEATURES = ("depth_diff", "max_width")
TUNE_KS = tuple(range(10, 201, 10))
CV_KS = tuple(range(10, 151, 10))
#: Scaled features are rounded for the check, as two engines scale with other last digits.
SCALED_DIGITS = 9


def query(fn: Callable[[Warehouse], DataFrame]) -> Callable[[Warehouse], DataFrame]:
    _QUERIES[fn.__name__] = lambda spark, folder: fn(Warehouse(spark, folder))
    return fn


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def rounded(df: DataFrame, *cols: str, digits: int = 4) -> DataFrame:
    """Round means for display, so that results do not show the order of summation.

    The first rounding clears the noise of the sum, the second sets the digits.
    """
    return df.withColumns({c: F.round(F.round(c, 10), digits) for c in cols})


def _depths(w: Warehouse) -> DataFrame:
    return pp.defender_depths(w.track, w.plays)


def _formations(w: Warehouse) -> DataFrame:
    return pp.formations(w.track, w.plays, w.players)


def _features(w: Warehouse, **options) -> DataFrame:
    """Play features are read several times by the classifiers; they are written once."""
    return cut_lineage(pp.spread_features(_depths(w), **options))


# ---- releases, plays, captions ------------------------------------------------


@query
def tracking_union(w):
    """Rows and totals per play and team of the unified frames."""
    frames = pl.unify_tracking(w.tracking_releases())
    numbers = ("nflid", "frameid", "jerseynumber", "x", "y", "s", "a", "dis", "o", "dir")
    return frames.groupBy("gameid", "playid", "team", "playdirection").agg(
        F.count(F.lit(1)).alias("n"), F.count("event").alias("events"), *[F.sum(c).alias(c) for c in numbers]
    )


#: Season of a game in the warehouse.
SEASON = "CASE (gameid - 2018000000) % 3 WHEN 0 THEN 2018 WHEN 1 THEN 2021 ELSE 2022 END"


@query
def release_load(w):
    """Frames written as packed CSV releases in three layouts, found, loaded and summed; some lines and one file do not fit."""
    base = scratch(w.spark)
    odd = (F.col("playid") * 7 + F.col("frameid")) % 97 == 0
    # As many files as the frames need: a packed file is read by one task, so a few long ones leave cores idle.
    laid = Warehouse(w.spark, w.folder, pp.buckets_for(w.table("lineitem"), fold=PER_FRAME))
    for year, release in zip((2018, 2021, 2022), laid.tracking_releases()):
        full = release.withColumn("x", F.when(odd, F.lit("oops")).otherwise(F.col("x").cast("string")))
        cells = [F.col(f.name) if f.name in full.columns else F.lit(None).cast("string").alias(f.name) for f in readers.layout(year)]
        sinks.write_csv(full.select(*cells), f"{base}/release-{year}/weeks", "gzip")
    sinks.write_csv(w.games.limit(1).select("gameid"), f"{base}/release-2022/weeks/extra")
    releases = readers.find_releases(w.spark, base, "release-*")
    files = {s: readers.find_files(w.spark, {s: f}, "weeks/*.csv.gz")[s] for s, f in releases.items()}
    files[2022] += readers.find_files(w.spark, {2022: releases[2022]}, "weeks/extra/*.csv")[2022]
    lines = readers.load_releases(w.spark, readers.release_manifest(w.spark, files), apart=False)
    sums = lines.groupBy("season", "reason").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x"), F.count("event").alias("events"))
    of_frames = [F.when(F.col("reason").isNull(), F.col(c)).alias(c) for c in ("x", "events")]
    return sums.select("season", F.coalesce("reason", F.lit("frames")).alias("kind"), "n", *of_frames)


@query
def table_round_trip(w):
    """One season's kept frames per play, from tables bucketed by play and kept by season: no shuffle, no other season read."""
    laid = Warehouse(w.spark, w.folder, pp.buckets_for(w.track))
    return pp.season_extents(*pp.stored_by_play(laid.track.withColumn("season", F.expr(SEASON)), laid.plays, laid.parts), 2021)


@query
def preds_files(w):
    """Odds written as files of two layouts, one per model and day, and read back in long form."""
    base = scratch(w.spark)
    named = w.model_preds.withColumn("file", F.format_string("%s_preds_%s", "model", F.date_format("date", "yyyyMMdd"))).drop("model", "date")
    one = F.col("file").startswith("one_high")
    for rows in (named.where(~one), named.where(one).drop("pred0", "pred2").withColumnRenamed("pred1", "pred")):
        rows.write.mode("append").partitionBy("file").options(header=True, nullValue="NA").csv(base)
    return readers.read_model_predictions(w.spark, [f"{base}/*"])


@query
def formations_file(w):
    """Formations through the CSV sink and its reader."""
    path = scratch(w.spark)
    sinks.write_csv(_formations(w), path)
    return readers.read_formations(w.spark, path)


@query
def games_union(w):
    return pl.unify_games(w.games_by_season())


@query
def players_union(w):
    return pl.unify_players(w.players_by_season())


@query
def plays_clean(w):
    return pl.clean_plays(w.plays_by_season(), pl.unify_games(w.games_by_season()), w.week_one)


@query
def play_details(w):
    cols = ["gameid", "playid", "season", "possessionteam_score", "defensiveteam_score"]
    return pl.play_details(w.plays, w.games).select(*cols, "down_distance", "scoreboard", "sitch", "location", "caption")


@query
def team_colors(w):
    return pl.team_colors(w.plays, w.color_grid)


# ---- tracking -----------------------------------------------------------------


@query
def play_crop(w):
    return tr.play_crop(w.track)


@query
def ball_spots(w):
    return tr.ball_spots(w.track, tr.play_crop(w.track))


@query
def clip_frames(w):
    """Rows and extent of the kept frames of every play."""
    crop = cut_lineage(tr.play_crop(w.track, with_rows=True))
    frames = tr.clip_frames(w.track, crop)
    return frames.groupBy("gameid", "playid", "snap", "clip").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("frameid").alias("first"),
        F.max("frameid").alias("last"),
        F.sum("x").alias("x"),
        F.sum("y").alias("y"),
    )


@query
def orient_coords(w):
    """Extent of the rotated coordinates of every play and team."""
    turned = tr.orient_coords(w.track)
    ends = [f(c).alias(f"{n}_{c}") for c in ("newx", "newy", "newo") for n, f in (("min", F.min), ("max", F.max))]
    return rounded(turned.groupBy("gameid", "playid", "team").agg(*ends), "min_newx", "max_newx", digits=6)


@query
def mean_positions(w):
    return rounded(pp.defender_positions(w.track, w.plays), "newx", "newy", "newspot_x", digits=6)


@query
def depth_by_play(w):
    cols = ["depth", "width", "first_down", "width_rk", "depth_rk", "side"]
    return _depths(w).select("gameid", "playid", "nflid", "pff_passcoverage", *cols)


@query
def play_frames(w):
    frames = pp.frame_table(w.track, w.plays, w.games, w.players, w.color_grid)
    cols = ["newx", "newy", "newo", "newspot", "line_to_gain", "skill", "color", "number_color", "shape", "caption"]
    return rounded(frames.select("gameid", "playid", "nflid", "frameid", "jerseynumber", "position", *cols), "newx", digits=6)


@query
def route_paths(w):
    frames = pp.frame_table(w.track, w.plays, w.games, w.players, w.color_grid)
    return rounded(tr.route_paths(frames), "newx", digits=6)


@query
def goal_lines_in_view(w):
    return tr.goal_lines_in_view(tr.orient_coords(w.track, shift=False), lines=(10, 30, 50, -30, -50))


@query
def yard_labels(w):
    turned = tr.orient_coords(w.track, shift=False).select(yard_label("newy").alias("yard"))
    return turned.groupBy(F.floor("yard").alias("yard")).agg(F.count(F.lit(1)).alias("n"))


@query
def event_crop(w):
    """The same crop on another event log: first sign-up and first purchase per user and day."""
    log = w.table("events").withColumn("day", F.to_date("ts"))
    return tr.play_crop(log, ("signup",), ("purchase",), ("user_id", "day"), "event_id", "event_type")


@query
def event_clip(w):
    keys = ("user_id", "day")
    log = w.table("events").withColumn("day", F.to_date("ts"))
    crop = cut_lineage(tr.play_crop(log, ("signup",), ("purchase",), keys, "event_id", "event_type", with_rows=True))
    kept = tr.clip_frames(log, crop, keys, "event_id")
    return kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


# ---- levels and zones ---------------------------------------------------------


@query
def depth_by_level(w):
    return rounded(zn.depth_by_level(_depths(w)), "depth", "width")


@query
def level_leaders(w):
    return rounded(zn.level_leaders(zn.depth_by_level(_depths(w))), "depth", "width")


@query
def zone_dim(w):
    """Bins of the grid with their zone and the defenders seen in each."""
    return zn.zone_grid_counts(_depths(w))


@query
def zone_dim_15(w):
    spec = zn.ZoneSpec(y_breaks=(-100, -20, -15, -10, 0, 15))
    return zn.zone_grid_counts(_depths(w), spec)


@query
def zone_heatmap(w):
    return zn.zone_heatmap(_depths(w))


@query
def depth_by_zone(w):
    return rounded(zn.depth_by_zone(_depths(w)), "depth", "width")


@query
def zone_profile(w):
    return rounded(zn.zone_profile(_depths(w)), "depth", "width")


@query
def zone_counts_by_play(w):
    return zn.zone_counts_by_play(_depths(w))


@query
def zone_usage(w):
    return rounded(zn.zone_usage(zn.zone_counts_by_play(_depths(w))), "count")


@query
def zone_features(w):
    return zn.zone_features(zn.zone_counts_by_play(_depths(w)))


@query
def composition_grid(w):
    features = zn.zone_features(zn.zone_counts_by_play(_depths(w)))
    names = ("blitz", "middle", "hooks", "flat", "third")
    return gr.grid_counts(gr.composition_grid(w.spark, names), features, {n: F.col(n).cast("int") for n in names})


@query
def deepest_players(w):
    return zn.deepest_players(_depths(w))


@query
def deepest_players_3d(w):
    return zn.deepest_players(_depths(w), centerfield=True)


@query
def deepest_three(w):
    return rounded(zn.deepest_players(_depths(w), ranks=(1, 2, 3), wide=True), "wide_width")


@query
def spread_by_coverage(w):
    return rounded(zn.spread_by_coverage(zn.deepest_players(_depths(w))), *FEATURES)


@query
def spread_density(w):
    """Distribution of the depth spread by coverage."""
    return sc.histogram(zn.deepest_players(_depths(w)), ["pff_passcoverage"], "depth_diff", 0.0, 30.0, 30)


@query
def depth_numbers(w):
    """Quartiles of a column with about as many values as rows."""
    return rounded(sc.five_numbers(_depths(w), ["pff_passcoverage", "side"], "depth"), "q1", "median", "q3", digits=6)


@query
def width_numbers(w):
    return rounded(sc.five_numbers(_depths(w), ["pff_passcoverage"], "width"), "q1", "median", "q3", digits=6)


@query
def side_profile(w):
    return rounded(zn.side_profile(_depths(w)), "width", "depth")


@query
def shallow_profile(w):
    return rounded(zn.shallow_profile(_depths(w)), "width", "depth")


@query
def rank_profile(w):
    return rounded(zn.rank_profile(_depths(w)), "width", "depth", "first_down")


@query
def random_play_depths(w):
    cols = ["gameid", "playid", "nflid", "depth", "width", "depth_rk"]
    return pp.random_play_depths(w.track, w.plays).select(*cols)


# ---- formations ---------------------------------------------------------------


@query
def alignment_by_play(w):
    return pp.alignments(w.track, w.plays, w.players)


@query
def alignment_sides(w):
    """Counts and sums of the alignment, one row per play."""
    cols = ("left_reach", "right_reach", "depth")
    return rounded(fm.alignment_sides(pp.alignments(w.track, w.plays, w.players)), *cols, digits=3)


@query
def formation_by_play(w):
    return _formations(w)


@query
def formation_frequency(w):
    return fm.formation_frequency(_formations(w))


@query
def named_formation(w):
    return fm.named_formation(_formations(w))


# ---- scoring ------------------------------------------------------------------


@query
def accuracy(w):
    return sc.accuracy(w.preds.withColumn("pred", sc.call()), ["set", "actual"])


@query
def class_recall(w):
    return sc.class_recall(w.preds.withColumn("pred", sc.call()), "actual")


@query
def confusion_pct(w):
    calls = w.preds.withColumn("pred", sc.call())
    return sc.confusion_pct(calls, ["pff_passcoverage"], "pred", [sc.ONE_HIGH, sc.TWO_HIGH], fill=0.0)


@query
def accuracy_by_formation(w):
    return sc.accuracy_by_formation(w.preds, _formations(w))


@query
def accuracy_spread(w):
    return sc.accuracy_spread(sc.accuracy_by_formation(w.preds, _formations(w)))


@query
def accuracy_by_defense(w):
    return sc.accuracy_by_defense(w.preds, _formations(w), w.plays, named=("nub twins", "flank", "empty open"))


@query
def false_positive_mix(w):
    return sc.false_positive_mix(w.preds, _formations(w))


@query
def having_total(w):
    """Defending teams of the games with many points, each row kept."""
    return sc.having_total(w.plays.select("gameid", "playid", "defensiveteam", "presnaphomescore"), ["gameid"], "presnaphomescore", 200)


@query
def clip_length(w):
    numbers = sc.clip_length(w.preds, _formations(w), tr.play_crop(w.track), named=("nub twins", "flank", "empty open"))
    return rounded(numbers, "q1", "median", "q3", digits=9)


@query
def odds_by_coverage(w):
    return sc.odds_by_coverage(w.preds, _formations(w))


@query
def odds_density(w):
    return sc.histogram(w.preds, ["actual", "pff_passcoverage"], "pred1", 0.0, 1.0, 16)


@query
def play_search(w):
    wanted = (
        F.col("pff_passcoverage").isin("Quarters", "Cover-6")
        & (F.col("season") == 2022)
        & F.col("pred0").between(0.4, 1)
        & F.col("formation").isin("empty open", "nub twins", "flank")
        & (F.col("frames") >= 1)
    )
    cols = ["gameid", "playid", "clip_id", "formation", "defensiveteam", "season", "pred0", "frames"]
    return sc.play_search(w.preds, _formations(w), tr.play_crop(w.track), w.plays, wanted).select(*cols)


@query
def sample_play(w):
    return sample_rows(w.preds.where(F.col("pred0").between(0.45, 0.55)), tr.PLAY).select("gameid", "playid", "pred0")


@query
def extreme_plays(w):
    """Clearest two-deep, Quarters and one-deep plays; the second and fourth surest mistakes."""
    p, up, down = w.preds, F.col("pred1").asc(), F.col("pred1").desc()
    two, one = p.where(F.col("actual") == sc.TWO_HIGH), p.where(F.col("actual") == sc.ONE_HIGH)
    found = {
        "two_high": sc.nth_play(two, [up]),
        "quarters": sc.nth_play(p.where(F.col("pff_passcoverage") == "Quarters"), [up]),
        "one_high": sc.nth_play(one, [down]),
        "missed_one_high": sc.nth_play(one, [up], 2),
        "false_one_high": sc.nth_play(two.where(F.col("pred1") > 0.5), [down], 4),
    }
    return pl.tag_union(found, "pick").select("pick", "gameid", "playid", "pred1")


@query
def preds_long(w):
    return sc.preds_long(w.model_preds)


@query
def preds_latest(w):
    return sc.preds_latest(sc.preds_long(w.model_preds))


def _mapped(w: Warehouse, **options) -> DataFrame:
    return sc.preds_mapped(sc.preds_latest(sc.preds_long(w.model_preds)), w.class_mapping, **options)


@query
def preds_mapped(w):
    cols = ["model", "date", "clip_id", "class", "actual", "odds", "actual_coverage", "pred_coverage", "match"]
    return _mapped(w).select(*cols)


@query
def preds_mapped_actual_only(w):
    return _mapped(w, collapse="actual").groupBy("model", "actual_coverage", "pred_coverage").count()


@query
def model_confusion(w):
    names = ("Cover-1", "Cover-3", "Quarters", "1-High", "2-High", "Cover-2", "Cover-6")
    return sc.confusion_pct(_mapped(w), ["model", "actual_coverage"], "pred_coverage", names, fill=0.0)


@query
def pooled_confusion(w):
    return sc.confusion_long(_mapped(w))


@query
def model_comparison(w):
    return sc.model_comparison(_mapped(w))


@query
def binary_outcome_class(w):
    truth = (F.col("actual") == sc.ONE_HIGH).cast("int")
    named = sc.binary_outcome_class(w.preds.withColumn("truth", truth), actual="truth")
    return sc.histogram(named, ["class"], "pred1", 0.0, 1.0, 8)


@query
def split_accuracy_report(w):
    return sc.split_accuracy_report(w.preds)


@query
def importance_report(w):
    """Mean and deviation of the odds by coverage, as printable text."""
    table = w.preds.groupBy(F.col("pff_passcoverage").alias("category")).agg(
        F.round(F.avg("pred1"), 6).alias("importance_mean"),
        F.when(F.col("category") != "2-Man", F.round(F.stddev_samp("pred1"), 6)).alias("importance_sd"),
    )
    return sc.importance_report(table)


@query
def scenario_grid(w):
    spot = (30 + F.col("playid") % 51).cast("int").alias("spot_y")
    plays = w.plays.select(spot, F.col("yardstogo").cast("int").alias("distance"), F.col("down").cast("int"))
    return gr.grid_counts(gr.scenario_grid(w.spark), plays, {c: F.col(c) for c in ("spot_y", "distance", "down")})


@query
def scenario_curve(w):
    spots = w.plays.select(*tr.PLAY, "down", "yardstogo", (30 + F.col("playid") % 51).alias("spot_y"))
    odds = spots.join(w.preds.select(*tr.PLAY, "pred1"), list(tr.PLAY))
    mean = odds.groupBy("down", "yardstogo", "spot_y").agg(F.round(F.avg("pred1"), 4).alias("pred1"))
    return sc.scenario_curve(mean)


# ---- sets and classifiers -----------------------------------------------------


@query
def train_split(w):
    return pp.spread_features(_depths(w)).groupBy("set", "hierarchy").agg(F.count(F.lit(1)).alias("n"))


@query
def training_plays(w):
    """Restrict a table to the plays of the training sets."""
    split = pp.spread_features(_depths(w))
    train = split.where(F.col("set") != "test").select(*tr.PLAY)
    return w.preds.join(train, list(tr.PLAY), "left_semi").select("gameid", "playid", "pred1")


@query
def folds(w):
    return kfold(w.plays.select(*tr.PLAY), tr.PLAY).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@query
def zscores(w):
    scaled = zscore(w.plays.select(*tr.PLAY, "yardstogo", "presnaphomescore"), ["yardstogo", "presnaphomescore"])
    return rounded(scaled, "yardstogo", "presnaphomescore", digits=6)


@query
def knn_classify(w):
    split = _features(w)
    ana, assess = split.where(F.col("set") == "ana"), split.where(F.col("set") == "assess")
    query_rows = assess.select(*tr.PLAY, *FEATURES)
    return nn.knn_classify(ana, query_rows, FEATURES, "pff_passcoverage", 10)


@query
def knn_tune(w):
    split = _features(w)
    ana, assess = split.where(F.col("set") == "ana"), split.where(F.col("set") == "assess")
    return nn.knn_tune(ana, assess, FEATURES, "pff_passcoverage", TUNE_KS)


@query
def knn_tune_high(w):
    split = _features(w)
    ana, assess = split.where(F.col("set") == "ana"), split.where(F.col("set") == "assess")
    return nn.knn_tune(ana, assess, FEATURES, "hierarchy", TUNE_KS)


@query
def knn_cv(w):
    train = _features(w).where(F.col("set") != "test")
    return nn.knn_cv(train, FEATURES, "hierarchy", CV_KS, digits=SCALED_DIGITS)


@query
def knn_cv_3d(w):
    train = _features(w, centerfield=True).where(F.col("set") != "test")
    return nn.knn_cv(train, (*FEATURES, "centerfielders"), "hierarchy", CV_KS, scale=FEATURES, digits=SCALED_DIGITS)


@query
def knn_cv_three(w):
    train = _features(w, ranks=(1, 2, 3), wide=True).where(F.col("set") != "test")
    exact = rounded(train, "wide_width").where(F.col("wide_width").isNotNull())
    return nn.knn_cv(exact, (*FEATURES, "wide_width"), "hierarchy", CV_KS, digits=SCALED_DIGITS)


@query
def knn_test(w):
    """Recall on the test plays of a vote among all training plays."""
    split = _features(w)
    test = split.where(F.col("set") == "test").select(*tr.PLAY, *FEATURES, "hierarchy")
    voted = nn.knn_classify(split.where(F.col("set") != "test"), test, FEATURES, "hierarchy", 150)
    return sc.class_recall(voted, "hierarchy")


@query
def decision_grid(w):
    train = _features(w).where(F.col("set") != "test")
    return nn.decision_grid(train, {c: range(21) for c in FEATURES}, "hierarchy", 150)


@query
def decision_grid_classes(w):
    """The grid for all coverages instead of the 0/1 label."""
    train = _features(w).where(F.col("set") != "test")
    return nn.decision_grid(train, {c: range(21) for c in FEATURES}, "pff_passcoverage", 150)


@query
def decision_grid_3d(w):
    train = _features(w, centerfield=True).where(F.col("set") != "test")
    ranges = {c: range(21) for c in FEATURES} | {"centerfielders": range(3)}
    return nn.decision_grid(train, ranges, "hierarchy", 150)


@query
def logistic_fit_score(w):
    counts = zn.zone_features(zn.zone_counts_by_play(_depths(w)))
    return lg.logistic_fit_score(cut_lineage(pp.train_split(counts, tr.PLAY)))


@query
def logistic_full(w):
    counts = zn.zone_features(zn.zone_counts_by_play(_depths(w)))
    split = cut_lineage(pp.train_split(counts, tr.PLAY))
    sets = ("ana", "assess")
    return lg.logistic_fit_score(split, sets, (*sets, "test"), merged={s: "train" for s in sets})
