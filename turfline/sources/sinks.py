"""Result and table sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from turfline.operators.tracking import PLAY


def write_csv(df: DataFrame, path: str, compression: str = "none") -> None:
    """CSV folder with a header, ``NA`` for missing; gzip at its fastest level, as its usual one takes longer than all else."""
    writer = df.write.mode("overwrite").options(header=True, nullValue="NA", compression=compression)
    writer.option("zlib.compress.level", "BEST_SPEED").csv(path)


def write_tracking(track: DataFrame, path: str, season: str | None = "season", keys: Sequence[str] = PLAY) -> None:
    """Parquet by season, each file sorted by play and frame.

    Sorted files give row groups that cover few plays, so a search for one play
    or a season reads only its own groups.
    """
    # The frame is part of the ranges, so that a play of any size can be divided.
    clustered = track.repartitionByRange(*([season] if season else []), *keys, "frameid").sortWithinPartitions(
        *([season] if season else []), *keys, "frameid"
    )
    writer = clustered.write.mode("overwrite")
    (writer.partitionBy(season) if season else writer).parquet(path)


def write_by_play(
    df: DataFrame, table: str, buckets: int, keys: Sequence[str] = PLAY, season: str | None = None, path: str | None = None
) -> None:
    """Table bucketed and sorted by play, and in folders by ``season`` if that is given.

    Play-level joins, aggregates and windows over tables bucketed alike need no
    shuffle; call the operators with ``hot_rows=None`` to use it. A filter on
    the season reads only its folders. With ``path`` the files lie there.
    """
    # One writer task per bucket keeps the number of files at ``buckets`` a season.
    # Rows laid out by play in as many parts are not moved for it.
    writer = df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
    if season:
        writer = writer.partitionBy(season)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
