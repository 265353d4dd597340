"""Approximate nearest neighbours: p-stable hash tables whose buckets are probed in order of estimated success."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turfline.functions.lineage import cut_lineage
from turfline.llm.common import flat_rows, table

#: Rows of the bounded sample that sets centre, scale and the number of hashes.
SAMPLE_ROWS = 2000
#: Width of a hash's bins, in deviations of the projected sample.
BIN = 1.2
#: Rows of a bucket, on average, that the number of hashes per table aims at.
BUCKET_ROWS = 300
#: Rows of a bucket that one task compares at a time; fuller buckets are cut by a hash of the row.
BLOCK_ROWS = 4000
#: Queries that a block is compared with at a time.
QUERY_ROWS = 2000
#: Buckets per table that the first pass probes.
FIRST_PROBES = 8
#: In place of a table, for queries that are compared with all rows.
ALL = -1


@dataclass
class Index:
    """Projections of every table (``tables`` x ``hashes`` x dimensions), bin offsets and width."""

    directions: np.ndarray
    offsets: np.ndarray
    width: float

    def place(self, vectors: np.ndarray) -> np.ndarray:
        """Position in bins, rows x tables x hashes; the integer part is the bucket."""
        return np.einsum("nd,thd->nth", vectors, self.directions) / self.width + self.offsets

    def probes(self, place: np.ndarray, distance: float, recall: float, least: int) -> Iterator[tuple]:
        """Buckets of one table for a query at ``place``, likeliest first.

        A neighbour at ``distance`` projects to a Gaussian about the query, so
        a bucket's chance is a product over the hashes. Buckets are visited
        until their chances add up to ``recall``, and ``least`` of them anyway.
        """
        sd = max(distance / self.width, 1e-6)
        reach = int(math.ceil(4 * sd)) + 1
        choices = []
        for x in place:
            low = math.floor(x)
            bins = np.arange(low - reach, low + reach + 1)
            edge = [0.5 * (1 + math.erf((b - x) / sd / math.sqrt(2))) for b in range(low - reach, low + reach + 2)]
            p = np.diff(edge)
            order = np.argsort(-p, kind="stable")
            choices.append([(float(p[i]), int(bins[i])) for i in order if p[i] > 1e-9])
        chance = lambda at: math.prod(c[i][0] for c, i in zip(choices, at))
        start = (0,) * len(choices)
        heap, seen, mass, n = [(-chance(start), start)], {start}, 0.0, 0
        while heap and (mass < recall or n < least):
            p, at = heapq.heappop(heap)
            mass, n = mass - p, n + 1
            yield tuple(c[i][1] for c, i in zip(choices, at))
            for j in range(len(at)):
                after = (*at[:j], at[j] + 1, *at[j + 1 :])
                if after[j] < len(choices[j]) and after not in seen:
                    seen.add(after)
                    heapq.heappush(heap, (-chance(after), after))


def fit(vectors: DataFrame, n_rows: int, tables: int, seed: int = 5) -> Index:
    """Directions, and a bin width from a bounded sample; hashes per table grow with the logarithm of the rows."""
    share = min(1.0, 2 * SAMPLE_ROWS / max(n_rows, 1))
    threshold = int(share * (1 << 32))
    picked = vectors.where(F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 32)) <= threshold).select("vector").limit(4 * SAMPLE_ROWS)
    sample = np.array([r.vector for r in picked.collect()], float)
    if not len(sample):
        sample = np.zeros((1, 1))
    rng = np.random.default_rng(seed)
    bits = math.log2(max(n_rows / BUCKET_ROWS, 2))
    per_hash = math.log2(math.sqrt(2 * math.pi * math.e) / BIN)
    hashes = max(1, round(bits / per_hash))
    directions = rng.standard_normal((tables, hashes, sample.shape[1]))
    spread = np.einsum("nd,thd->nth", sample, directions).std(axis=0).mean()
    return Index(directions, rng.random((tables, hashes)), float(BIN * spread) or 1.0)


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``key`` and ``vector`` as doubles; without null, empty and zero vectors and non-finite components."""
    v = F.col("vector")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    clean = df.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    sound = clean.where(F.col("key").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0.0))
    return sound.groupBy("key").agg(F.min("vector").alias("vector"))


def _code(bins) -> str:
    return ",".join(map(str, bins))


def _nearest(q_ids, q: np.ndarray, limits: np.ndarray, ids, x: np.ndarray, k: int) -> tuple[list, list, list]:
    """The ``k`` nearest rows of a block within every query's limit: query ids, row ids, distances in double precision."""
    out: tuple[list, list, list] = ([], [], [])
    square = np.einsum("nd,nd->n", x, x)
    for s in range(0, len(q), 256):
        part = q[s : s + 256]
        rough = square[None] - 2 * part @ x.T
        for i, row in enumerate(rough):
            # Expanding the square rounds; rows that may tie with the last are all measured exactly.
            at = np.arange(len(x))
            if len(x) > k:
                size = max(square.max(), part[i] @ part[i])
                at = np.flatnonzero(row <= np.partition(row, k - 1)[k - 1] + 1e-9 * (1 + size))
            d = np.sqrt(((x[at] - part[i]) ** 2).sum(1))
            order = np.lexsort((np.asarray(ids)[at], d))[:k]
            order = order[d[order] <= limits[s + i]]
            out[0].extend([q_ids[s + i]] * len(order))
            out[1].extend(np.asarray(ids)[at[order]].tolist())
            out[2].extend(d[order].tolist())
    return out


def _search(index_rows: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """Meet probes and blocks of the same bucket: ``query``, ``found``, ``score``; each found pair once."""

    def meet(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asked):
            return pd.DataFrame({"query": [], "found": [], "score": []}).astype({"query": "int64", "found": "int64", "score": "float64"})
        q = np.stack(asked["q_vector"].to_numpy())
        a, b, d = _nearest(asked["query"].tolist(), q, asked["limit"].to_numpy(), rows["key"].to_numpy(), np.stack(rows["vector"].to_numpy()), k)
        return pd.DataFrame({"query": a, "found": b, "score": d})

    # A bucket that many queries probe is met once per so many of them.
    parts = probes.groupBy("table", "code", "block").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("parts"))
    probes = probes.join(parts, ["table", "code", "block"]).withColumn("part", F.pmod(F.xxhash64("query", F.lit(2)), "parts").cast("int")).drop("parts")
    index_rows = index_rows.join(parts, ["table", "code", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    by = ("table", "code", "block", "part")
    found = index_rows.groupBy(*by).cogroup(probes.groupBy(*by)).applyInPandas(meet, "query long, found long, score double")
    return found.groupBy("query", "found").agg(F.min("score").alias("score"))


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "found"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 10, tables: int = 3, recall: float = 0.97) -> DataFrame:
    """The ``k`` nearest rows of every query by Euclidean distance: ``query_id``, ``rank``, ``vec_id``, ``score``.

    Rows of equal vectors are one entry of the index with their least ``k`` + 1
    keys, which is all that an answer can hold of them, and equal queries are
    searched once. A first pass probes the likeliest buckets and
    so finds a distance for every query; the second probes, in order of
    success, until a neighbour at that distance is met with the chance
    ``recall`` over all tables. Queries far from the rest, which would probe
    more buckets than a table has, or for which the second pass found too few
    rows within the distance it was sized for, are compared with all rows.
    Candidates of all passes are merged and ranked
    by their distance on the original vectors; equal distances go to the
    smaller key. A query never finds its own key. Vectors that are null or
    zero, or hold null or non-finite components, take no part, nor do rows
    with a null key; of repeated keys with different vectors, the least vector counts.
    """
    kept = usable(vectors, key, vector)
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("key"))
    few = kept.withColumn("r", rank).where(F.col("r") <= k + 1)  # pruned before the shuffle
    members = few.groupBy("vector").agg(F.min("key").alias("entry"), F.sort_array(F.collect_list("key")).alias("keys"))
    entries = cut_lineage(members.select(F.col("entry").alias("key"), "vector", "keys"))
    n = entries.count()
    shared = vectors.sparkSession.sparkContext.broadcast(fit(entries, n, tables))
    asked = usable(queries, key, vector).distinct()
    asked = cut_lineage(asked.select(F.col("key").alias("query_id"), "vector").join(entries.select("vector", F.col("key").alias("query")), "vector").select("query_id", "query"))
    distinct = entries.join(asked.select(F.col("query").alias("key")).distinct(), "key", "left_semi")

    def placed():
        def of(keys, given):
            if not keys:
                return [], [], [], []
            codes = np.floor(shared.value.place(np.array(given, float))).astype(int)
            t = codes.shape[1]
            return [x for x in keys for _ in range(t)], [x for x in given for _ in range(t)], list(range(t)) * len(keys), [_code(c) for row in codes for c in row]

        return of

    coded = cut_lineage(flat_rows(entries, ["key", "vector"], placed, "key long, vector array<double>, table int, code string"))
    # Buckets with more rows are cut into blocks; every query of the bucket meets them all.
    blocks = coded.groupBy("table", "code").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    blocks = cut_lineage(blocks)
    rows = coded.join(blocks, ["table", "code"]).withColumn("block", F.pmod(F.xxhash64("key", F.lit(1)), "blocks").cast("int")).select("key", "vector", "table", "code", "block")

    most = blocks.groupBy("table").count().agg(F.max("count")).first()[0] or 0

    def probing(wanted: float, least: int):
        def make():
            def of(keys, given, distances, limits):
                out = ([], [], [], [], [])
                if keys:
                    at = shared.value.place(np.array(given, float))
                    for key_, v, d, limit, places in zip(keys, given, distances, limits, at):
                        listed = []
                        for t, p in enumerate(places):
                            found = list(islice(shared.value.probes(p, d, wanted, least), max(most, least) + 1))
                            if len(found) > max(most, least):
                                # Probing would visit more buckets than there are.
                                listed = [(ALL, "")]
                                break
                            listed += [(t, _code(bins)) for bins in found]
                        for t, code in listed:
                            for o, x in zip(out, (key_, v, limit, t, code)):
                                o.append(x)
                return out

            return of

        return make

    def probe(points: DataFrame, wanted: float, least: int) -> DataFrame:
        listed = flat_rows(points, ["key", "vector", "distance", "limit"], probing(wanted, least), "query long, q_vector array<double>, limit double, table int, code string")
        spread = listed.join(blocks, ["table", "code"], "left").where(F.col("blocks").isNotNull() | (F.col("table") == ALL))
        spread = spread.withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
        return cut_lineage(spread.select("query", "q_vector", "limit", "table", "code", "block"))

    width = float(shared.value.width)
    spread = F.lit(width / BIN * math.sqrt(2))
    any_ = F.lit(float("inf"))
    first = cut_lineage(_search(rows, probe(distinct.withColumns({"distance": F.lit(width / 4), "limit": any_}), 0.0, FIRST_PROBES), k + 1))
    reach = _best(first, k + 1).groupBy("query").agg(F.max("score").alias("far"), F.count(F.lit(1)).alias("n"))
    # A query that met too few rows has no distance yet; the second pass tries that of two typical rows, and
    # is checked. Otherwise its rows are at most that far, and the second pass gives no others.
    full = F.coalesce(F.col("n"), F.lit(0)) > k
    known = distinct.join(reach, distinct["key"] == reach["query"], "left").select(
        "key", "vector", F.when(full, F.col("far")).otherwise(spread).alias("distance"), F.when(full, F.col("far")).otherwise(any_).alias("limit")
    )
    known = cut_lineage(known)
    wanted = 1 - (1 - recall) ** (1 / tables)
    probed = probe(known, wanted, 2)
    second = _search(rows, probed.where(F.col("table") != ALL), k + 1)
    found = cut_lineage(first.union(second).groupBy("query", "found").agg(F.min("score").alias("score")))
    # Not covered: queries that were not probed, or have fewer rows than asked for within the distance of their probes.
    met = _best(found, k + 1).groupBy("query").agg(F.max("score").alias("far"), F.count(F.lit(1)).alias("n"))
    whole = probed.where(F.col("table") == ALL).select("query", F.lit(True).alias("whole")).distinct()
    short = (F.coalesce(F.col("n"), F.lit(0)) <= k) | (F.col("far") > F.col("distance"))
    left = known.withColumnRenamed("key", "query").join(met, "query", "left").join(whole, "query", "left").where(short | F.col("whole"))
    left = cut_lineage(left.select("query", F.col("vector").alias("q_vector"), F.when(F.col("n") > k, F.col("far")).otherwise(any_).alias("limit")))
    if not left.isEmpty():
        pieces = math.ceil(n / BLOCK_ROWS)
        everything = entries.select("key", "vector", F.lit(ALL).alias("table"), F.lit("").alias("code"), F.pmod(F.xxhash64("key", F.lit(1)), F.lit(pieces)).cast("int").alias("block"))
        asking = left.select("*", F.lit(ALL).alias("table"), F.lit("").alias("code"), F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("block"))
        third = _search(everything, asking, k + 1)
        found = found.union(third).groupBy("query", "found").agg(F.min("score").alias("score"))
    best = _best(found, k + 1)
    named = entries.select(F.col("key").alias("found"), "keys")
    answers = asked.join(best.select("query", "found", "score"), "query").join(named, "found").select("query_id", "score", F.explode("keys").alias("vec_id"))
    answers = answers.where(F.col("vec_id") != F.col("query_id"))
    last = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return answers.withColumn("rank", last).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, rows.where(F.col("vec_id") % 100 == 0))
