"""Exact top-k by inner product: best-first search in M-trees of bounded size.

Rows go to the nearest of a bounded set of sampled pivots; a region with more
rows than one tree takes is dealt by hash over several trees. Each tree is
bulk-loaded in its own task and stored as rows of a page table: a page holds
routing objects with covering radius and distance to the page's own object, or
vectors with that distance.

For a query ``q`` and any vector ``x`` within ``r`` of an object ``c``,
``q.x <= q.c + |q| r``. The same with the stored distance to the page's object
bounds an entry before its product is computed. Pages wait in a heap by bound; a
search ends when the best bound is below the k-th score. A query first searches
the most promising region, and then, with the score found there, all trees
that can still hold better or equal rows.

The pivots only place rows, so results are exact whatever the sample. Of equal
vectors the k + 1 smallest ids take part, as no others can be among the k
nearest; so a vector that fills the table is a few rows.

Vectors that are null or hold a null, NaN or infinite component take no part;
an empty vector has the product 0 with all, and a shorter vector counts as
filled with zeros. Rows with equal ids are rows of their own, a query's own row
is no candidate, others with its id are. A null id comes after all others at
equal scores and makes no query. Components and scores beyond the range of a
long stop at its ends. An empty table has an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turfline.functions.lineage import cut_lineage
from turfline.llm.common import table
from turfline.llm.sample import by_hash

#: Vectors of a tree, entries of a page, queries of a group; fewer vectors and queries if they have more components than fit CELLS.
TREE_ROWS = 16_384
PAGE = 128
CHUNK = 8_192
CELLS = 4_000_000
#: Most pivots: the bound of what is broadcast.
MOST_PIVOTS = 4_096
#: Whole numbers below this are exact as doubles, sums included.
EXACT = 2.0**53
#: Relative room for rounding in distances and bounds.
SLACK = 1e-9

_PAGES = "region int, part int, page int, leaf boolean, ids array<bigint>, names array<bigint>, cells array<bigint>, dims int, radii array<double>, away array<double>"
_FOUND = "qkey bigint, key bigint, vec_id bigint, score bigint"


def whole(vector: Column, scale: int = 256) -> Column:
    """Components times ``scale``, rounded down."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))


def usable(vector: Column) -> Column:
    """Whether a vector and all its components are there and finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def matrix(rows, dims: int | None = None) -> np.ndarray:
    """Vectors as rows of whole numbers, short ones filled with zeros."""
    rows = [np.asarray(r, np.int64) for r in rows]
    width = max((len(r) for r in rows), default=0) if dims is None else dims
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of two matrices of whole numbers, as whole numbers."""
    width = min(left.shape[1], right.shape[1])
    left, right = left[:, :width], right[:, :width]
    if not (left.size and right.size):
        return np.zeros((len(left), len(right)), np.int64)
    a, b = np.abs(left.astype(float)).max(), np.abs(right.astype(float)).max()
    if a * b * width < EXACT:
        return (left.astype(float) @ right.astype(float).T).astype(np.int64)
    exact = left.astype(object) @ right.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def floor_of(score: float) -> float:
    """A score as the least that still counts; beyond exact doubles with room for rounding."""
    return score if abs(score) < EXACT else score - abs(score) * SLACK


def distances(points: np.ndarray, center: np.ndarray) -> np.ndarray:
    gap = points.astype(float) - center.astype(float)
    return np.sqrt((gap * gap).sum(1))


@dataclass
class Page:
    """Entries by falling reach: the ids of rows or of child pages, and how far each lies from the page's object."""

    leaf: bool
    ids: np.ndarray
    names: np.ndarray
    vectors: np.ndarray
    radii: np.ndarray
    away: np.ndarray

    def __post_init__(self):
        self.reach = self.away + self.radii
        self.safe = bool(np.abs(self.vectors.astype(float)).max(initial=0.0) < 2**20)
        self.floats = self.vectors.astype(float) if self.safe else None


def load(vectors: np.ndarray, capacity: int = PAGE) -> list[tuple[bool, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bulk-load a tree: pages of ``leaf, ids, objects, radii, away``; the first page is the root.

    ``ids`` are rows of ``vectors`` in a leaf and pages elsewhere, ``objects``
    rows of ``vectors`` that stand for the entries. The root's distances are
    from the row that is nearest to the mean.
    """
    pages: list = []

    def center_of(rows: np.ndarray) -> int:
        return int(rows[distances(vectors[rows], vectors[rows].astype(float).mean(0)).argmin()])

    def divide(rows: np.ndarray) -> list[np.ndarray]:
        """At most ``capacity`` parts around rows picked evenly; by count where all are equal."""
        n = min(capacity, -(-len(rows) // capacity))
        seeds = vectors[rows[np.linspace(0, len(rows) - 1, max(n, 2)).astype(int)]].astype(float)
        points = vectors[rows].astype(float)
        near = ((seeds * seeds).sum(1) - 2 * points @ seeds.T).argmin(1)
        parts = [rows[near == i] for i in range(len(seeds)) if (near == i).any()]
        return parts if len(parts) > 1 else [p for p in np.array_split(rows, max(n, 2)) if len(p)]

    todo = [(np.arange(len(vectors)), center_of(np.arange(len(vectors))), 0)]
    pages.append(None)
    while todo:
        rows, center, page = todo.pop()
        if len(rows) <= capacity:
            away = distances(vectors[rows], vectors[center])
            order = np.argsort(-away, kind="stable")
            pages[page] = (True, rows[order], rows[order], np.zeros(len(rows)), away[order])
            continue
        parts = divide(rows)
        centers = [center_of(p) for p in parts]
        radii = np.array([distances(vectors[p], vectors[c]).max() for p, c in zip(parts, centers)])
        away = distances(vectors[centers], vectors[center])
        order = np.argsort(-(away + radii), kind="stable")
        first = len(pages)
        pages += [None] * len(parts)
        pages[page] = (False, first + np.arange(len(parts)), np.array(centers)[order], radii[order], away[order])
        todo += [(parts[i], centers[i], first + at) for at, i in enumerate(order)]
    return pages


class Search:
    """Best-first search of one tree; counts the products it computed."""

    def __init__(self, pages: dict[int, Page], root: np.ndarray):
        self.pages, self.root, self.computed = pages, root[None, :], 0

    def _scores(self, page: Page, upto: int, query: np.ndarray, floats: np.ndarray | None) -> np.ndarray:
        self.computed += upto
        if page.safe and floats is not None:
            return (page.floats[:upto] @ floats).astype(np.int64)
        return products(page.vectors[:upto], query[None, :])[:, 0]

    def top(self, query: np.ndarray, own: int, k: int, floor: float = -np.inf) -> list[tuple[int, int, int]]:
        """The ``k`` best ``(score, name, id)`` that are at least ``floor``, without the row ``own``; names rise at equal scores."""
        norm = float(np.sqrt((query.astype(float) ** 2).sum()))
        floats = query.astype(float) if np.abs(query.astype(float)).max(initial=0.0) < 2**20 and len(query) < 2**13 else None
        at = float(products(self.root, query[None, :])[0, 0])
        best: list[tuple[int, int, int]] = []
        least = floor_of(floor) if np.isfinite(floor) else floor
        heap = [(-np.inf, 0, at)]
        while heap:
            bound, number, at = heapq.heappop(heap)
            if -bound < least:
                break
            page = self.pages[number]
            # Entries by falling reach: the ones that can matter come first.
            room = SLACK * (abs(at) + norm * (page.reach[0] if len(page.reach) else 0.0)) + SLACK
            upto = len(page.ids) if least == -np.inf else int(np.searchsorted(-(at + norm * page.reach + room), -least, side="right"))
            if not upto:
                continue
            scores = self._scores(page, upto, query, floats)
            if page.leaf:
                for i in np.nonzero(scores >= least)[0]:
                    if page.ids[i] != own:
                        best.append((-int(scores[i]), int(page.names[i]), int(page.ids[i])))
                if len(best) >= k:
                    best = sorted(best)[:k]
                    if len(best) == k:
                        least = max(least, floor_of(float(-best[-1][0])))
            else:
                bounds = scores + norm * page.radii[:upto] * (1 + SLACK) + SLACK * np.abs(scores) + SLACK
                for i in np.nonzero(bounds >= least)[0]:
                    heapq.heappush(heap, (-float(bounds[i]), int(page.ids[i]), float(scores[i])))
        return [(-s, name, key) for s, name, key in sorted(best)[:k]]


def _pivots(rows: DataFrame, n_rows: int, tree_rows: int) -> np.ndarray:
    """As many sampled vectors as trees are needed, chosen by hash, at most ``MOST_PIVOTS``."""
    wanted = min(MOST_PIVOTS, max(1, -(-n_rows // tree_rows)))
    # More than wanted are asked for, as a hash may pick none of a few.
    picked = by_hash(rows.select("key", "v"), "key", wanted + 32, n_rows).collect()
    return matrix([r["v"] for r in picked[:wanted]])


def _nearest(points: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest pivot, and the distance to it."""
    width = max(points.shape[1], pivots.shape[1])
    p = np.pad(points.astype(float), ((0, 0), (0, width - points.shape[1])))
    c = np.pad(pivots.astype(float), ((0, 0), (0, width - pivots.shape[1])))
    region = ((c * c).sum(1) - 2 * p @ c.T).argmin(1)
    gap = p - c[region]
    return region, np.sqrt((gap * gap).sum(1))


@dataclass
class Index:
    """Page table of all trees, and the regions: pivot, covering radius and number of trees of each."""

    pages: DataFrame
    pivots: np.ndarray
    radii: np.ndarray
    parts: np.ndarray
    n_rows: int
    width: int


def build(vectors: DataFrame, k: int, tree_rows: int = TREE_ROWS) -> Index:
    """Index rows of ``key, vec_id, v`` for searches of the best ``k``; ``v`` holds whole numbers."""
    copies = Window.partitionBy("v").orderBy(F.asc_nulls_last("vec_id"), "key")
    rows = cut_lineage(vectors.withColumn("_n", F.row_number().over(copies)).where(F.col("_n") <= k + 1).drop("_n"))
    n_rows, width = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    tree_rows = max(1, min(tree_rows, CELLS // max(width or 0, 1)))
    pivots = _pivots(rows, n_rows, tree_rows) if n_rows else np.zeros((0, 0), np.int64)
    shared = rows.sparkSession.sparkContext.broadcast(pivots)  # at most MOST_PIVOTS vectors

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                region, away = _nearest(matrix(b["v"]), shared.value)
                yield b.assign(region=region.astype("int32"), away=away)

    placed = cut_lineage(rows.mapInPandas(place, "key bigint, vec_id bigint, v array<bigint>, region int, away double"))
    # One row per region.
    sizes = {r["region"]: r for r in placed.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("far")).collect()}
    parts = np.array([-(-sizes[i]["n"] // tree_rows) if i in sizes else 0 for i in range(len(pivots))], int)
    radii = np.array([sizes[i]["far"] if i in sizes else 0.0 for i in range(len(pivots))], float)
    # A literal of at most MOST_PIVOTS numbers.
    in_region = F.get(F.array(*[F.lit(int(p)) for p in parts]), F.col("region")) if len(parts) else F.lit(1)
    dealt = placed.withColumn("part", F.pmod(F.xxhash64("key"), in_region).cast("int"))

    def pages(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key")
        points, ids = matrix(rows["v"]), rows["key"].to_numpy()
        names = rows["vec_id"].astype("Int64")
        none = names.isna().to_numpy()
        names = np.where(none, np.iinfo(np.int64).max, names.fillna(0).to_numpy(np.int64))
        out = []
        for number, (leaf, entries, objects, far, away) in enumerate(load(points)):
            out.append(
                {
                    "region": key[0], "part": key[1], "page": number, "leaf": leaf,
                    "ids": ids[entries] if leaf else entries.astype(np.int64), "names": names[entries] if leaf else np.zeros(0, np.int64),
                    "cells": points[objects].ravel(), "dims": points.shape[1], "radii": far, "away": away,
                }
            )
        # The root's own object, which its distances are from.
        mid = int(distances(points, points.astype(float).mean(0)).argmin())
        empty = np.zeros(0)
        out.append(
            {
                "region": key[0], "part": key[1], "page": -1, "leaf": False, "ids": empty.astype(np.int64), "names": empty.astype(np.int64),
                "cells": points[mid], "dims": points.shape[1], "radii": empty, "away": empty,
            }
        )
        return pd.DataFrame(out)

    trees = max(1, int(parts.sum()))
    spread = dealt.select("region", "part", "key", "vec_id", "v").repartition(trees, "region", "part")
    stored = cut_lineage(spread.groupBy("region", "part").applyInPandas(pages, _PAGES))
    return Index(stored, pivots, radii, parts, n_rows, width or 0)


def opened(pages: pd.DataFrame) -> tuple[dict[int, Page], np.ndarray]:
    found, root = {}, np.zeros(0, np.int64)
    for r in pages.itertuples(index=False):
        cells = np.asarray(r.cells, np.int64)
        if r.page < 0:
            root = cells
            continue
        ids = np.asarray(r.ids, np.int64)
        names = np.asarray(r.names, np.int64)
        found[int(r.page)] = Page(bool(r.leaf), ids, names, cells.reshape(len(ids), r.dims), np.asarray(r.radii, float), np.asarray(r.away, float))
    return found, root


def search(index: Index, queries: DataFrame, k: int, chunk: int = CHUNK) -> DataFrame:
    """The ``k`` best rows of every query (``qkey``, its own row key, and ``v``): ``qkey, rank, key, vec_id, score``."""
    spark = queries.sparkSession
    if not index.n_rows:
        return spark.createDataFrame([], "qkey bigint, rank int, key bigint, vec_id bigint, score bigint")
    chunk = max(1, min(chunk, CELLS // max(index.width, 1)))
    regions = spark.sparkContext.broadcast((index.pivots, index.radii, index.parts))  # at most MOST_PIVOTS vectors

    def bounds(v: np.ndarray) -> np.ndarray:
        """Upper bound of the products with every region's rows."""
        pivots, radii, parts = regions.value
        norms = np.sqrt((v.astype(float) ** 2).sum(1))
        mid = products(v, pivots).astype(float)
        out = mid + norms[:, None] * radii * (1 + SLACK) + SLACK * np.abs(mid) + SLACK
        return np.where(parts > 0, out, -np.inf)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One tree per query to begin with."""
        for b in batches:
            if len(b):
                region = bounds(matrix(b["v"])).argmax(1)
                part = b["qkey"].to_numpy() % regions.value[2][region]
                yield b.assign(region=region.astype("int32"), part=part.astype("int32"), floor=-np.inf)

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Every other tree whose bound reaches the score found."""
        parts = regions.value[2]
        for b in batches:
            if not len(b):
                continue
            floor = np.array([floor_of(f) if np.isfinite(f) else f for f in b["floor"]], float)
            i, region = np.nonzero(bounds(matrix(b["v"])) >= floor[:, None])
            n = parts[region]
            i, region = np.repeat(i, n), np.repeat(region, n)
            part = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            new = (region != b["region"].to_numpy()[i]) | (part != b["part"].to_numpy()[i])
            rows = b.iloc[i[new]]
            yield rows.assign(region=region[new].astype("int32"), part=part[new].astype("int32"))

    def meet(asked: DataFrame) -> DataFrame:
        """Trees and the queries sent to them; queries come in chunks, each beside a copy of the pages."""
        sizes = asked.groupBy("region", "part").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(chunk))).cast("int").alias("chunks"))
        sizes = cut_lineage(sizes)  # one row per tree
        key = ["region", "part", "chunk"]
        tasks = int(sizes.agg(F.sum("chunks")).first()[0] or 1)
        q = asked.join(sizes, ["region", "part"]).withColumn("chunk", F.pmod(F.xxhash64("qkey"), F.col("chunks")).cast("int"))
        p = index.pages.join(sizes, ["region", "part"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        q = q.select("qkey", "v", "floor", *key).repartition(tasks, *key).groupBy(*key)
        p = p.drop("chunks").repartition(tasks, *key).groupBy(*key)

        def find(queries: pd.DataFrame, pages: pd.DataFrame) -> pd.DataFrame:
            found = []
            if len(queries) and len(pages):
                tree, root = opened(pages)
                run = Search(tree, root)
                v = matrix(queries["v"], max(len(root), max(map(len, queries["v"]))))
                for row, own, floor in zip(v, queries["qkey"].to_numpy(), queries["floor"].to_numpy(float)):
                    found += [(own, key, name, score) for score, name, key in run.top(row[: len(root)], own, k, floor)]
            return pd.DataFrame(found, columns=["qkey", "key", "vec_id", "score"])

        return q.cogroup(p).applyInPandas(find, _FOUND)

    shape = "qkey bigint, v array<bigint>, region int, part int, floor double"
    first = cut_lineage(queries.select("qkey", "v").mapInPandas(best, shape))
    seeds = cut_lineage(meet(first))
    # A floor only if a full k rows were found.
    floors = seeds.groupBy("qkey").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).cast("double").alias("_low"))
    tight = first.join(floors, "qkey", "left").withColumn("floor", F.coalesce("_low", "floor")).drop("_low")
    rest = cut_lineage(tight.select("qkey", "v", "region", "part", "floor").mapInPandas(others, shape))
    order = Window.partitionBy("qkey").orderBy(F.desc("score"), "vec_id", "key")
    ranked = seeds.unionByName(meet(rest)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = F.when(F.col("vec_id") != np.iinfo(np.int64).max, F.col("vec_id"))
    return ranked.select("qkey", F.col("rank").cast("int"), "key", named.alias("vec_id"), "score")


def whole_rows(df: DataFrame, vector: str = "embedding", name: str = "vec_id") -> DataFrame:
    """Usable rows of a table as ``key, vec_id, v``, written once."""
    kept = df.where(usable(F.col(f"`{vector}`")))
    rows = kept.select(F.monotonically_increasing_id().alias("key"), F.col(f"`{name}`").cast("bigint").alias("vec_id"), whole(F.col(f"`{vector}`")).alias("v"))
    return cut_lineage(rows)


def op12_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 greatest inner products of every fiftieth vector with all others, on whole numbers."""
    rows = whole_rows(table(spark, sf_dir, "embeddings"))
    queries = rows.where(F.col("vec_id") % 50 == 0).select(F.col("key").alias("qkey"), "v", F.col("vec_id").alias("query_id"))
    found = search(build(rows, 5), queries, 5)
    return found.join(queries.select("qkey", "query_id"), "qkey").select("query_id", "rank", "vec_id", "score")
