"""Whole analyses: from tracking frames to the tables behind each report.

Each analysis first reduces the frames to one row per play (where it starts and
ends, where the ball lies) and writes that table once. Its size is then known,
so the join back to the frames can broadcast it or, if it is too large,
shuffle, and the frames are not scanned again for every use. The rest of the
plan is lazy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turfline.functions.lineage import cut_lineage, scratch
from turfline.functions.sampling import row_hash, sample_group, train_split
from turfline.functions.skew import HOT_ROWS, has_hot
from turfline.operators import formations as fm
from turfline.operators import plays as pl
from turfline.operators import tracking as tr
from turfline.operators import zones as zn
from turfline.sources.sinks import write_by_play

ONE_HIGH_COVERAGES = ("Cover-1", "Cover-3")


def _positions(track: DataFrame, plays: DataFrame, hot_rows: int | None) -> tuple[DataFrame, bool]:
    """Mean positions, and whether some play has too many rows for one task.

    The crop counts the rows of every play, which bounds its defenders too.
    """
    crop = cut_lineage(tr.play_crop(track, with_rows=hot_rows is not None))
    return tr.mean_positions(track, crop, plays, hot_rows=hot_rows), has_hot(crop, hot_rows)


def defender_positions(track: DataFrame, plays: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Mean position of every defender between snap and clip."""
    return _positions(track, plays, hot_rows)[0]


def defender_depths(
    track: DataFrame,
    plays: DataFrame,
    coverages: Sequence[str] = tr.COVERAGES,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Ranked defenders of the plays with a chosen coverage.

    Plays of other coverages are dropped before their frames are averaged.
    """
    wanted = plays.where(F.col("pff_passcoverage").isin(*coverages))
    positions, wide = _positions(track, wanted, hot_rows)
    if wide:
        positions = cut_lineage(positions)
    return tr.depth_by_play(positions, wanted, coverages, wide=wide)


def random_play_depths(
    track: DataFrame, plays: DataFrame, coverages: Sequence[str] = tr.COVERAGES, seed: int = 15, tries: int = 4
) -> DataFrame:
    """Ranked defenders of one play chosen by hash, without reading the frames of all others.

    The first plays in hash order are picked from the play table, and their keys
    are pushed into the scan of the frames. Plays without a start or without
    defenders fall out; if all do, the next ones are tried, more at a time.
    """
    wanted = plays.where(F.col("pff_passcoverage").isin(*coverages)).select(*tr.PLAY).distinct()
    order = row_hash(tr.PLAY, seed)
    after = ""
    while True:
        rows = wanted.select(*tr.PLAY, order.alias("_h")).where(F.col("_h") > after).orderBy("_h").limit(tries).collect()
        near = [F.col(k).isin([r[k] for r in rows]) for k in tr.PLAY]
        these = near[0] & near[1] & row_hash(tr.PLAY, seed).isin([r["_h"] for r in rows])
        found = cut_lineage(defender_depths(track.where(these), plays.where(these), coverages))
        if len(rows) < tries or found.head(1):
            return sample_group(found, tr.PLAY, seed)
        after, tries = rows[-1]["_h"], tries * 4


#: Rows of a bucket of frames: few enough to be sorted in memory.
BUCKET_ROWS = 4_000_000


def buckets_for(track: DataFrame, least: int = 16, fold: int = 1) -> int:
    """Buckets for a table of frames; they grow with the frames, so that a bucket does not.

    The frames may be counted by a thin table instead, of which a row becomes at most ``fold`` of theirs.
    """
    return max(least, -(-track.count() * fold // BUCKET_ROWS))


def stored_by_play(track: DataFrame, plays: DataFrame, buckets: int = 16) -> tuple[DataFrame, DataFrame]:
    """Frames and plays as tables bucketed by play, the frames in folders by season, both below the application's folder.

    Frames laid out by play in as many parts as there are ``buckets`` are written where they are.
    """
    tables = []
    for df in (track, plays.drop("season")):
        path = scratch(track.sparkSession)
        name = f"turfline_{path.rsplit('/', 1)[-1]}"
        write_by_play(df, name, buckets, season="season" if "season" in df.columns else None, path=path)
        tables.append(track.sparkSession.table(name))
    return tables[0], tables[1]


def season_extents(track: DataFrame, plays: DataFrame, season: int) -> DataFrame:
    """Kept frames of every play of a season with its coverage: their number, first and last one, and sums of the coordinates.

    Over tables of ``stored_by_play`` crop, joins and sums stay in the buckets.
    """
    frames = track.where(F.col("season") == season)
    kept = tr.clip_frames(frames, tr.play_crop(frames), hot_rows=None)
    named = kept.join(plays.select(*tr.PLAY, "pff_passcoverage"), list(tr.PLAY))
    return named.groupBy(*tr.PLAY, "pff_passcoverage").agg(
        F.count(F.lit(1)).alias("n"), F.min("frameid").alias("first"), F.max("frameid").alias("last"), F.sum("x").alias("x"), F.sum("y").alias("y")
    )


def alignments(track: DataFrame, plays: DataFrame, players: DataFrame) -> DataFrame:
    """Offensive players at the snap."""
    snaps = cut_lineage(fm.snap_places(track))
    return fm.alignment_by_play(track, plays, players, snaps)


def formations(track: DataFrame, plays: DataFrame, players: DataFrame) -> DataFrame:
    """Formation string of every play."""
    return fm.formation_by_play(alignments(track, plays, players))


def frame_table(
    track: DataFrame, plays: DataFrame, games: DataFrame, players: DataFrame, color_grid: DataFrame
) -> DataFrame:
    """Everything needed to draw any play."""
    snaps = cut_lineage(tr.play_crop(track, ("ball_snap",), (), with_rows=True))
    colors = pl.team_colors(plays, color_grid)
    return tr.play_frames(track, pl.play_details(plays, games), players, colors, snaps=snaps)


def spread_features(depths: DataFrame, **options) -> DataFrame:
    """Features of the deepest defenders with the one-deep label and a data set tag."""
    label = F.col("pff_passcoverage").isin(*ONE_HIGH_COVERAGES).cast("int")
    return train_split(zn.deepest_players(depths, **options).withColumn("hierarchy", label), tr.PLAY)
