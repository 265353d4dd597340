"""Readers for the CSV releases and result files.

Columns get lower-case names; Spark resolves names without regard to case, so
queries may spell them as the files do.
"""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turfline.functions.lineage import cut_lineage
from turfline.operators.plays import TRACKING_COLUMNS, clean_plays, stack, unify_games, unify_players, unify_tracking
from turfline.operators.scoring import preds_long
from turfline.sources import schemas

#: Types of the columns whose files differ in layout; the rest is text.
_KNOWN = {
    "gameid": "int", "playid": "int", "season": "int", "week": "int", "quarter": "int", "down": "int",
    "yardstogo": "int", "presnaphomescore": "int", "presnapvisitorscore": "int", "isdropback": "boolean",
    "homefinalscore": "int", "visitorfinalscore": "int",
}
#: Files whose header is read at a time.
HEADER_THREADS = 16


def read_csv(spark: SparkSession, paths: str | Sequence[str], schema, **options) -> DataFrame:
    """CSV with a header line, a fixed schema by position and ``NA`` for missing.

    A value that does not fit its type stops the read; it is not nulled silently.
    """
    settings = {"header": True, "nullValue": "NA", "mode": "FAILFAST"} | options
    return spark.read.schema(schema).options(**settings).csv(paths)


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Column names in a file's first line; only that line is read."""
    line = spark.read.text(path).first()[0]
    return [name.strip() for name in next(csv.reader([line]))]


def _first_line(spark: SparkSession, url: str) -> tuple[str, str | None]:
    """A file's name and its first line, unpacked as the name says and as Spark reads it; None if the file is empty."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(url))
    files = path.getFileSystem(conf)
    if not files.getFileStatus(path).getLen():
        return str(path), None
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
    stream = files.open(path)
    try:
        unpacked = stream if codec is None else codec.createInputStream(stream)
        line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(unpacked, "UTF-8")).readLine()
    finally:
        stream.close()
    return str(path), line and line.removeprefix("\ufeff")


def headers(spark: SparkSession, paths: str | Sequence[str]) -> dict[str, str]:
    """First line of every file by its name, in name order; nothing else of a file is read, however long or packed it is.

    The driver opens the files, a few at a time, through Hadoop's file system, as it lists them.
    """
    found = sorted(spark.read.text(paths).inputFiles())
    with ThreadPoolExecutor(HEADER_THREADS) as pool:
        return {file: line for file, line in pool.map(lambda url: _first_line(spark, url), found) if line is not None}


def _names(header: str) -> list[str]:
    return [name.strip().lower() for name in next(csv.reader([header]))]


def by_header(spark: SparkSession, paths: str | Sequence[str]) -> dict[str, list[str]]:
    """Files per distinct header; the driver holds one line per file, as it holds their names."""
    found: dict[str, list[str]] = {}
    for file, header in headers(spark, paths).items():
        found.setdefault(header, []).append(file)
    return found


def read_named(spark: SparkSession, path: str | Sequence[str], types: Mapping[str, str] = _KNOWN, default: str = "string") -> DataFrame:
    """CSV whose columns are taken from its header line and typed by name.

    For files whose columns differ between releases: one line is read on the
    driver, the rows themselves never are. Every file of the path must have the
    same columns in the same order; another header stops the read.
    """
    fields = [(n.lower(), types.get(n.lower(), default)) for n in header_of(spark, path if isinstance(path, str) else path[0])]
    schema = T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in fields))
    return read_csv(spark, path, schema, enforceSchema=False)


def load_tracking(spark: SparkSession, by_season: Mapping[int, str | Sequence[str]]) -> DataFrame:
    """Tracking frames of the given releases in one layout of 15 columns, and their ``season``.

    A season's layout is its own, whichever seasons are given; a file whose
    header has other columns stops the read.
    """
    legs = {s: read_csv(spark, by_season[s], schemas.TRACKING[s], enforceSchema=False) for s in sorted(by_season)}
    return stack([unify_tracking([df]).withColumn("season", F.lit(s)) for s, df in legs.items()])


def layout(year: int) -> T.StructType:
    """Columns of a release's tracking files, in order."""
    return T.StructType.fromDDL(schemas.TRACKING[year])


def release_manifest(spark: SparkSession, files: Mapping[int, Sequence[str]]) -> list[dict]:
    """What a load will read: ``season, layout, header, files`` for every season and distinct header.

    The layout is the release whose columns the header names, in any order; None if there is no such release.
    """
    entries = []
    for season, paths in sorted(files.items()):
        for header, group in by_header(spark, list(paths)).items():
            names = _names(header)
            fits = [year for year in schemas.TRACKING if sorted(layout(year).names) == sorted(names)]
            entries.append({"season": season, "layout": fits[0] if fits else None, "header": header, "files": group})
    return entries


def load_releases(spark: SparkSession, manifest: Sequence[Mapping], apart: bool = True) -> tuple[DataFrame, DataFrame] | DataFrame:
    """Tracking frames of a manifest in one layout with ``season``, and what did not fit: ``season, file, line, reason``.

    One plan leg per entry, however many files it has. Lines are parsed once
    and written, so that frames and rejects come from the same reading. A line
    with a value of another type or another number of values is a reject with
    its text; a file without a known layout is one reject without line.

    Without ``apart`` frames and rejects are one table, ``reason`` is null for
    frames, and nothing is written: for a caller that goes over them once. The
    cells of all columns are checked there as well, whichever are used.
    """
    legs, unknown = [], []
    for entry in manifest:
        if entry["layout"] is None:
            unknown += [(entry["season"], f, None, "unknown header") for f in entry["files"]]
            continue
        types = {f.name: f for f in layout(entry["layout"])}
        schema = T.StructType([types[n] for n in _names(entry["header"])]).add("_line", T.StringType())
        # Without pruning, so that the number of values of a line is checked.
        lines = read_csv(spark, entry["files"], schema, mode="PERMISSIVE", columnNameOfCorruptRecord="_line", columnPruning=False)
        named = lines.withColumnRenamed("club", "team") if "team" not in schema.names else lines
        cells = [F.col(c).alias(c) for c in TRACKING_COLUMNS]
        # Spark converts, and so checks, only the cells that are asked for. This asks for all and is always true.
        missing = sum((F.col(c).isNull().cast("int") for c in TRACKING_COLUMNS), F.lit(0))
        asked = F.col("_line").isNull() | (missing <= len(cells))
        legs.append(
            named.where(asked).select(
                *cells, F.lit(entry["season"]).alias("season"), F.col("_metadata.file_path").alias("file"), F.col("_line").alias("line"),
                F.when(F.col("_line").isNotNull(), "value").alias("reason"),
            )
        )
    shape = "season int, file string, line string, reason string"
    rejects = spark.createDataFrame(unknown, shape)
    if not legs:
        frames = spark.createDataFrame([], T.StructType([layout(2021)[c] for c in TRACKING_COLUMNS]).add("season", T.IntegerType()))
        return (frames, rejects) if apart else stack([frames, rejects])
    if not apart:
        return stack([*legs, rejects])
    parsed = cut_lineage(stack(legs))
    bad = parsed.where(F.col("reason").isNotNull()).select(*rejects.columns)
    return parsed.where(F.col("reason").isNull()).drop("file", "line", "reason"), bad.unionByName(rejects)


def load_games(spark: SparkSession, by_season: Mapping[int, str | Sequence[str]]) -> DataFrame:
    return unify_games({s: read_named(spark, p) for s, p in by_season.items()})


def load_players(spark: SparkSession, by_season: Mapping[int, str]) -> DataFrame:
    return unify_players({s: read_csv(spark, p, schemas.PLAYERS) for s, p in by_season.items()})


def load_plays(spark: SparkSession, by_season: Mapping[int, str], games: DataFrame, coverages: str) -> DataFrame:
    """Cleaned plays of all seasons; ``coverages`` is the label file of the first one."""
    raw = {s: read_named(spark, p) for s, p in by_season.items()}
    return clean_plays(raw, games, read_csv(spark, coverages, schemas.COVERAGES))


def find_releases(spark: SparkSession, base: str, pattern: str, seasons: Sequence[int] = (2018, 2021, 2022)) -> dict[int, str]:
    """Release folders under ``base`` whose name matches ``pattern``, in name order, by season.

    Listing goes through Hadoop's file system, so ``base`` may be any storage
    Spark can read.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    glob = hadoop.Path(f"{base}/{pattern}")
    found = glob.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(glob) or []
    folders = sorted(str(f.getPath()) for f in found if f.isDirectory())
    if len(folders) != len(seasons):
        raise ValueError(f"expected {len(seasons)} folders like {pattern} under {base}, found {len(folders)}")
    return dict(zip(seasons, folders))


def find_files(spark: SparkSession, releases: Mapping[int, str], pattern: str) -> dict[int, list[str]]:
    """Files of every release folder that match ``pattern`` (such as ``games.csv`` or ``weeks/*.csv``), in name order."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    out = {}
    for season, folder in releases.items():
        glob = hadoop.Path(f"{folder}/{pattern}")
        found = glob.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(glob) or []
        out[season] = sorted(str(f.getPath()) for f in found if f.isFile())
        if not out[season]:
            raise ValueError(f"no file like {pattern} under {folder}")
    return out


def read_color_grid(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.COLOR_GRID)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Stored one-deep odds; the 0/1 label becomes 2-High/1-High."""
    label = F.when(F.col("actual") == 1, "1-High").when(F.col("actual") == 0, "2-High")
    return read_csv(spark, path, schemas.PREDICTIONS).withColumn("actual", label)


def read_formations(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.FORMATIONS)


def read_importances(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.IMPORTANCES)


def read_scenario_predictions(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.SCENARIO_PREDICTIONS)


def _file_facts(df: DataFrame, suffix: str) -> DataFrame:
    """Model and date from the file name, ``<model>_<suffix>...<yyyymmdd>...``, or from its folder's, as Spark writes folders."""
    parts = F.split(F.col("_metadata.file_path"), "/")
    file, folder = F.element_at(parts, -1), F.element_at(parts, -2)
    name = F.when(file.contains(suffix), file).otherwise(F.regexp_replace(folder, "^[^=]*=", ""))
    model = F.regexp_replace(F.regexp_substr(name, F.lit(f".+{suffix}")), f"_{suffix}$", "")
    date = F.to_date(F.regexp_substr(name, F.lit(r"\d{8}")), "yyyyMMdd")
    return df.select("*", model.alias("model"), date.alias("date"))


def read_model_predictions(spark: SparkSession, paths: str | Sequence[str], skip: str = "hierarchy") -> DataFrame:
    """Odds per clip and class from the files of all models, long form.

    Files differ in their class columns. One job reads all headers, and the
    files of a header are one leg of the plan; model and date come from the
    file's metadata. Files or folders whose name contains ``skip`` are left out.
    """
    parts = []
    for header, files in by_header(spark, paths).items():
        kept = [f for f in files if not (skip and any(skip in part for part in f.split("/")[-2:]))]
        if not kept:
            continue
        names = _names(header)
        types = {"clip_id": "bigint"} | {n: "double" for n in names if "pred" in n}
        schema = T.StructType.fromDDL(", ".join(f"`{n}` {types.get(n, 'string')}" for n in names))
        parts.append(preds_long(_file_facts(read_csv(spark, kept, schema, enforceSchema=False), "preds")))
    return stack(parts)


def read_class_mapping(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Coverage names of each model's classes."""
    return _file_facts(read_csv(spark, paths, schemas.CLASS_MAPPING), "mapping").drop("date")
