"""Exact k-nearest-neighbour classification as a partitioned join.

Every neighbour within the k-th distance votes, equal distances included; the
label with most votes wins, the first in text order on equal votes.

The training rows are first counted per distinct point and label, so a point
that holds a third of the table becomes one row. Space is then cut into leaves
by a tree built from a sample (the sample shapes the partitioning only, never
the answer). Row counts and extents of the leaves bound the k-th distance of
every query; its own leaf tightens the bound, and then it meets only those
other leaves that reach into it.

The tree has two levels. The upper one is built from a bounded sample and known
to every task. A leaf that holds more points than one task compares gets a tree
of its own, built in its own task from a bounded sample of its points; trees,
counts and extents of these leaves are rows of a table, and only the points and
queries of a leaf meet its tree. So a query follows two trees down, whatever the
size of the table, and nothing that grows with it passes the driver.

Leaf, leaf below it and chunk of queries are the grouping key, so every task is
bounded, whatever the skew. Candidates are plain rows, counted and voted on by
aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turfline.functions.lineage import cut_lineage
from turfline.functions.sampling import kfold, zscore
from turfline.operators.grids import value_grid
from turfline.operators.tracking import PLAY

#: Distinct training points per leaf, queries per chunk, points of a large leaf that one task deals to the leaves below.
LEAF_POINTS = 2_000
CHUNK_QUERIES = 2_000
PIECE_POINTS = 250_000
#: Most partitions of a search.
MOST_TASKS = 20_000
#: Distances held at once by a task; a few megabytes stay in the cache.
BLOCK_CELLS = 500_000
#: Sampled points per leaf for placing the cuts, and most sampled points of the
#: upper tree and of each tree below it: 50,000 leaves, and as many in each of
#: them.
SAMPLE_PER_LEAF = 20
MOST_SAMPLED = 1_000_000

_TREE = "leaf int, axis array<int>, value array<double>, left array<int>, right array<int>, leaf_at array<int>"
_FOUND = "qid bigint, d double, label string, n bigint, radius double"


@dataclass
class Cuts:
    """Axis-parallel cuts of the feature space as a binary tree; ``left`` and ``right`` of a node, or its ``leaf``."""

    axis: np.ndarray
    value: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaf: np.ndarray
    leaves: int

    @staticmethod
    def through(points: np.ndarray, leaves: int) -> "Cuts":
        """Halve the fullest part along its widest axis until there are ``leaves`` parts or only single points.

        A cut lies at the median, but below the greatest value, so both sides get points.
        """
        least = max(1, len(points) // max(leaves, 1))
        nodes: list[list] = []
        todo, n_leaves = [(points, -1, 0)], 0
        while todo:
            part, parent, side = todo.pop()
            here = len(nodes)
            nodes.append([0, 0.0, -1, -1, -1])
            if parent >= 0:
                nodes[parent][2 + side] = here
            extent = np.ptp(part, axis=0) if len(part) else np.zeros(1)
            if len(part) <= least or not extent.any():
                nodes[here][4] = n_leaves
                n_leaves += 1
                continue
            axis = int(np.argmax(extent))
            column = part[:, axis]
            value = np.median(column)
            if value >= column.max():
                value = column[column < column.max()].max()
            nodes[here][:2] = axis, float(value)
            low = column <= value
            todo += [(part[low], here, 0), (part[~low], here, 1)]
        axis, value, left, right, leaf = zip(*nodes)
        return Cuts(np.array(axis), np.array(value), np.array(left), np.array(right), np.array(leaf), n_leaves)

    def reach(self, points: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of point index and leaf whose cell the point's ball may touch."""
        found_point, found_leaf = [], []
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, idx = todo.pop()
            if not len(idx):
                continue
            if self.leaf[node] >= 0:
                found_point.append(idx)
                found_leaf.append(np.full(len(idx), self.leaf[node]))
                continue
            at = points[idx, self.axis[node]] - self.value[node]
            todo.append((self.left[node], idx[at - radius[idx] <= 0]))
            todo.append((self.right[node], idx[at + radius[idx] > 0]))
        if not found_point:
            return np.zeros(0, int), np.zeros(0, int)
        return np.concatenate(found_point), np.concatenate(found_leaf)

    def row(self) -> tuple[list, ...]:
        """The arrays as the columns of ``_TREE``."""
        return tuple(a.tolist() for a in (self.axis, self.value, self.left, self.right, self.leaf))

    @staticmethod
    def of_row(row) -> "Cuts":
        arrays = [np.array(row[c], float if c == "value" else int) for c in ("axis", "value", "left", "right", "leaf_at")]
        return Cuts(*arrays, int(arrays[-1].max()) + 1)

    def home(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), int)
        idx, leaf = self.reach(points, np.zeros(len(points)))
        out[idx] = leaf
        return out


@dataclass
class Extents:
    """Per node of a tree: rows in all, rows of each fold, and the box around its points."""

    cuts: Cuts
    rows: np.ndarray
    by_fold: dict[int, np.ndarray]
    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def of(cuts: Cuts, leaf_rows: pd.DataFrame, dims: int) -> "Extents":
        """From ``leaf, fold, n, low, high``, one row per leaf and fold."""
        size = len(cuts.axis)
        node_of = {int(leaf): node for node, leaf in enumerate(cuts.leaf) if leaf >= 0}
        rows, by_fold = np.zeros(size), {}
        low, high = np.full((size, dims), np.inf), np.full((size, dims), -np.inf)
        for r in leaf_rows.itertuples(index=False):
            node = node_of[int(r.leaf)]
            rows[node] += r.n
            by_fold.setdefault(int(r.fold), np.zeros(size))[node] += r.n
            low[node] = np.minimum(low[node], r.low)
            high[node] = np.maximum(high[node], r.high)
        for node in range(size - 1, -1, -1):  # children follow their parent
            for child in (cuts.left[node], cuts.right[node]):
                if child >= 0:
                    rows[node] += rows[child]
                    for counts in by_fold.values():
                        counts[node] += counts[child]
                    low[node] = np.minimum(low[node], low[child])
                    high[node] = np.maximum(high[node], high[child])
        return Extents(cuts, rows, by_fold, low, high)

    def bound(self, points: np.ndarray, folds: np.ndarray | None, k: int) -> np.ndarray:
        """Upper bound of each k-th squared distance: the far corner of the smallest node around with k rows.

        Infinite only where the whole table has less than ``k`` rows of other folds.
        """
        out = np.full(len(points), np.inf)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, idx = todo.pop()
            if not len(idx):
                continue
            left = np.full(len(idx), self.rows[node])
            if folds is not None:
                for fold, counts in self.by_fold.items():
                    left[folds[idx] == fold] -= counts[node]
            idx = idx[left >= k]
            if not len(idx):
                continue
            far = np.maximum(np.abs(points[idx] - self.low[node]), np.abs(points[idx] - self.high[node]))
            out[idx] = np.minimum(out[idx], (far**2).sum(1) * (1 + 1e-9))
            if self.cuts.leaf[node] < 0:
                low = points[idx, self.cuts.axis[node]] <= self.cuts.value[node]
                todo += [(self.cuts.left[node], idx[low]), (self.cuts.right[node], idx[~low])]
        return out


def _squared(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances, summed axis by axis in the order of the features."""
    total = np.zeros((len(queries), len(points)))
    for j in range(points.shape[1]):
        gap = queries[:, j, None] - points[None, :, j]
        total += gap * gap
    return total


def _matrix(p: pd.Series, dims: int) -> np.ndarray:
    return np.array(p.tolist(), float).reshape(-1, dims)


def _candidates(queries: pd.DataFrame, points: pd.DataFrame, dims: int, k: int, folded: bool) -> pd.DataFrame:
    """Rows of all points that can be among the ``k`` nearest of a query, and the distance of its k-th point here."""
    x, pts = _matrix(queries["p"], dims), _matrix(points["p"], dims)
    qid, limit = queries["qid"].to_numpy(), queries["radius"].to_numpy()
    label, n = points["label"].to_numpy(), points["n"].to_numpy()
    parts = []
    block = max(1, BLOCK_CELLS // max(len(pts), 1))
    for start in range(0, len(x) if len(pts) else 0, block):
        rows = slice(start, start + block)
        dist = _squared(x[rows], pts)
        if folded:
            dist[queries["fold"].to_numpy()[rows, None] == points["fold"].to_numpy()[None, :]] = np.inf
        # A point is a row at least, so the k-th point bounds the k-th row.
        kth = np.partition(dist, k - 1, axis=1)[:, k - 1] if len(pts) >= k else np.full(len(dist), np.inf)
        most = np.minimum(kth, limit[rows])
        i, j = np.nonzero((dist <= most[:, None]) & np.isfinite(dist))
        parts.append((qid[rows][i], dist[i, j], label[j], n[j], most[i]))
    if not parts:
        parts = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object), np.zeros(0, np.int64), np.zeros(0))]
    columns = [np.concatenate(c) for c in zip(*parts)]
    return pd.DataFrame(dict(zip(("qid", "d", "label", "n", "radius"), columns)))


def _at_trees(rows: DataFrame, forest: DataFrame, chunk: int, step, schema: str) -> DataFrame:
    """``step(rows, extents of their leaf)`` for rows at large leaves, in chunks, each beside a copy of the leaf's tree."""
    sizes = cut_lineage(rows.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(chunk))).cast("int").alias("chunks")))
    named = T._parse_datatype_string(schema).names
    cut = rows.join(sizes, "leaf").withColumn("chunk", F.pmod(F.xxhash64("p", "fold"), F.col("chunks")).cast("int")).select(*named, "chunk")
    trees = forest.join(sizes, "leaf").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")

    def run(rows: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        rows = rows[named]
        return step(rows, _open(tree.iloc[0])) if len(rows) else rows

    return cut.groupBy("leaf", "chunk").cogroup(trees.groupBy("leaf", "chunk")).applyInPandas(run, schema)


def _open(row) -> Extents:
    cuts = Cuts.of_row(row)
    if row["boxes"] is None:
        return Extents(cuts, np.zeros(0), {}, np.zeros(0), np.zeros(0))
    boxes = pd.DataFrame([(b["sub"], b["fold"], b["n"], b["low"], b["high"]) for b in row["boxes"]], columns=["leaf", "fold", "n", "low", "high"])
    return Extents.of(cuts, boxes, len(boxes["low"].iloc[0]))


def _divide(points: DataFrame, large: dict[int, int], unit: int, dims: int, summary: list) -> tuple[DataFrame, DataFrame]:
    """Points with the leaf below their leaf, and the trees of the large leaves with counts and extents."""
    context = points.sparkSession.sparkContext
    wanted = context.broadcast({leaf: -(-n // unit) for leaf, n in large.items()})
    share = context.broadcast({leaf: min(1.0, min(SAMPLE_PER_LEAF * -(-n // unit), MOST_SAMPLED) / n) for leaf, n in large.items()})

    @F.pandas_udf("double")
    def share_of(leaf: pd.Series) -> pd.Series:
        return leaf.map(share.value).astype(float)

    def grow(key: tuple, sample: pd.DataFrame) -> pd.DataFrame:
        ordered = sorted(map(tuple, sample["p"]))
        cuts = Cuts.through(_matrix(pd.Series(ordered), dims), wanted.value[key[0]])
        return pd.DataFrame([(key[0], *cuts.row())], columns=["leaf", "axis", "value", "left", "right", "leaf_at"])

    inside = points.where(F.col("leaf").isin(list(large)))
    low = F.pmod(F.xxhash64("p", "fold", "label"), F.lit(1 << 30))
    sampled = inside.where(low <= share_of("leaf") * (1 << 30)).select("leaf", "p")
    # One point of every leaf for certain.
    sampled = sampled.unionByName(inside.groupBy("leaf").agg(F.min("p").alias("p")))
    trees = cut_lineage(sampled.groupBy("leaf").applyInPandas(grow, _TREE))
    fields = "p array<double>, fold int, label string, n bigint, leaf int, sub int"
    bare = trees.withColumn("boxes", F.lit(None).cast("array<struct<sub: int, fold: int, n: bigint, low: array<double>, high: array<double>>>"))

    def deal(rows: pd.DataFrame, leaf: Extents) -> pd.DataFrame:
        return rows.assign(sub=leaf.cuts.home(_matrix(rows["p"], dims)).astype("int32"))

    dealt = cut_lineage(_at_trees(inside, bare, PIECE_POINTS, deal, fields))
    boxes = dealt.groupBy("leaf", "sub", "fold").agg(*summary)
    # At most as many entries as a tree has leaves, for each fold.
    listed = boxes.groupBy("leaf").agg(F.collect_list(F.struct("sub", "fold", "n", "low", "high")).alias("boxes"))
    forest = cut_lineage(trees.join(listed, "leaf"))
    rest = points.where(~F.col("leaf").isin(list(large)))
    return rest.unionByName(dealt), forest


def knn_votes(
    train: DataFrame,
    query: DataFrame,
    features: Sequence[str],
    label: str,
    ks: Sequence[int],
    fold: str | None = None,
    leaf_points: int = LEAF_POINTS,
    chunk_queries: int = CHUNK_QUERIES,
) -> DataFrame:
    """Predicted label of each distinct query point for every k.

    With ``fold`` a training row is no neighbour
    of a query of the same fold. Returns features (and fold), ``k``, ``pred``.
    """
    dims, k_max = len(features), max(ks)
    point = F.array(*[F.col(c).cast("double") for c in features])
    known = [F.col(c).isNotNull() for c in features]
    complete = known[0]
    for c in known[1:]:
        complete = complete & c
    held = [F.col(fold).cast("int").alias("fold")] if fold else [F.lit(-1).alias("fold")]
    # Both sides are read several times below; they are written once.
    points = cut_lineage(
        train.where(complete & F.col(label).isNotNull())
        .groupBy(point.alias("p"), *held, F.col(label).cast("string").alias("label"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    asked = cut_lineage(query.where(complete).select(point.alias("p"), *held).distinct().withColumn("qid", F.monotonically_increasing_id()))
    context = train.sparkSession.sparkContext

    size = points.count()
    leaves = max(1, -(-size // max(leaf_points, 4 * k_max)))
    # Chosen by hash alone, so that a rerun builds the same tree.
    share = min(1.0, min(SAMPLE_PER_LEAF * leaves, MOST_SAMPLED) / max(size, 1))
    picked = points.where(F.pmod(F.xxhash64("p", "fold", "label"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("p").toPandas()["p"]
    sample = _matrix(picked.sort_values(key=lambda s: s.map(tuple)) if len(picked) else picked, dims)
    cuts = Cuts.through(sample, leaves)
    tree = context.broadcast(cuts)

    @F.pandas_udf("int")
    def leaf_of(p: pd.Series) -> pd.Series:
        return pd.Series(tree.value.home(_matrix(p, dims)))

    points = cut_lineage(points.select("p", "fold", "label", "n", leaf_of("p").alias("leaf")))
    corners = [F.array(*[f(F.col("p")[i]) for i in range(dims)]).alias(name) for name, f in (("low", F.min), ("high", F.max))]
    summary = [F.sum("n").alias("n"), F.count(F.lit(1)).alias("points"), *corners]
    # One row per leaf and fold, at most MOST_SAMPLED / SAMPLE_PER_LEAF leaves.
    box = points.groupBy("leaf", "fold").agg(*summary).toPandas()
    extents = context.broadcast(Extents.of(cuts, box[["leaf", "fold", "n", "low", "high"]], dims))
    unit = max(leaf_points, 4 * k_max)
    large = {int(leaf): int(n) for leaf, n in box.groupby("leaf")["points"].sum().items() if n > 2 * unit}
    forest = None
    points = points.withColumn("sub", F.lit(0))
    if large:
        points, forest = _divide(points, large, unit, dims, summary)

    def meet(queries: DataFrame) -> DataFrame:
        """Search with queries in bounded chunks, each beside a copy of its leaf."""
        place = ["leaf", "sub"]
        # One row per leaf below; written, as the planner goes by its size.
        sizes = cut_lineage(queries.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / F.lit(float(chunk_queries))).cast("int").alias("chunks")))
        q = queries.join(sizes, place).withColumn("chunk", F.pmod(F.xxhash64("qid"), F.col("chunks")).cast("int"))
        t = points.join(sizes, place).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        # The groups are small in bytes but heavy in work: spread them by number,
        # so that partitions are not merged by size.
        key, groups = [*place, "chunk"], sizes.agg(F.sum("chunks")).first()[0] or 1
        tasks = min(2 * int(groups), MOST_TASKS)
        q = q.select("qid", "p", "fold", "radius", *key).repartition(tasks, *key).groupBy(*key)
        t = t.select("p", "fold", "label", "n", *key).repartition(tasks, *key).groupBy(*key)
        return q.cogroup(t).applyInPandas(lambda a, b: _candidates(a, b, dims, k_max, bool(fold)), _FOUND)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = _matrix(b["p"], dims)
            bound = extents.value.bound(x, b["fold"].to_numpy() if fold else None, k_max)
            yield b.assign(leaf=tree.value.home(x).astype("int32"), sub=np.int32(0), radius=bound)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of a query for every other leaf within its radius; a large leaf counts as another to its own queries."""
        for b in batches:
            r = b["radius"].to_numpy()
            idx, leaf = tree.value.reach(_matrix(b["p"], dims), np.sqrt(r) * (1 + 1e-12))
            own = b["leaf"].to_numpy()[idx]
            other = (leaf != own) | np.isin(leaf, list(large))
            rows = b.iloc[idx[other]]
            home = np.where(leaf == own, b["sub"].to_numpy()[idx], -1)[other]
            yield rows.assign(leaf=leaf[other].astype("int32"), sub=home.astype("int32"))

    located = "p array<double>, fold int, qid bigint, leaf int, sub int, radius double"
    in_large = F.col("leaf").isin(list(large)) if large else F.lit(False)

    def below(queries: DataFrame, step) -> DataFrame:
        """Queries at large leaves go down the trees there, the others stay as they are."""
        if forest is None:
            return queries
        return queries.where(~in_large).unionByName(_at_trees(queries.where(in_large), forest, chunk_queries, step, located))

    def settle(queries: pd.DataFrame, leaf: Extents) -> pd.DataFrame:
        x = _matrix(queries["p"], dims)
        bound = leaf.bound(x, queries["fold"].to_numpy() if fold else None, k_max)
        return queries.assign(sub=leaf.cuts.home(x).astype("int32"), radius=np.minimum(queries["radius"].to_numpy(), bound))

    def spread(queries: pd.DataFrame, leaf: Extents) -> pd.DataFrame:
        idx, sub = leaf.cuts.reach(_matrix(queries["p"], dims), np.sqrt(queries["radius"].to_numpy()) * (1 + 1e-12))
        new = sub != queries["sub"].to_numpy()[idx]
        return queries.iloc[idx[new]].assign(sub=sub[new].astype("int32"))

    asked = cut_lineage(below(asked.select("p", "fold", "qid").mapInPandas(place, located), settle))
    found = cut_lineage(meet(asked))
    # The own leaf gives a bound of the k-th distance.
    tight = found.groupBy("qid").agg(F.min("radius").alias("near"))
    nearer = asked.join(tight, "qid", "left").select("p", "fold", "qid", "leaf", "sub", F.least("radius", "near").alias("radius"))
    sent = nearer.mapInPandas(send, located)
    if forest is None:  # no leaf is large, so none has leaves below
        sent = sent.withColumn("sub", F.lit(0))
    else:
        sent = below(sent.withColumn("sub", F.when(in_large, F.col("sub")).otherwise(0)), spread)
    found = found.unionByName(meet(cut_lineage(sent)))

    # A row takes part in the vote of k if fewer than k rows are nearer.
    counted = found.groupBy("qid", "d", "label").agg(F.sum("n").alias("n"))
    nearer_rows = F.sum("n").over(Window.partitionBy("qid").orderBy("d")) - F.sum("n").over(Window.partitionBy("qid", "d"))
    ranked = counted.withColumn("before", nearer_rows)
    tally = ranked.groupBy("qid", "label").agg(*[F.sum(F.when(F.col("before") < k, F.col("n"))).alias(f"k{k}") for k in ks])
    first = [F.min(F.when(F.col(f"k{k}").isNotNull(), F.struct(-F.col(f"k{k}"), "label")))["label"].alias(f"k{k}") for k in ks]
    winners = tally.groupBy("qid").agg(*first)
    ballots = F.explode(F.array(*[F.struct(F.lit(int(k)).alias("k"), F.col(f"k{k}").alias("pred")) for k in ks])).alias("_v")
    voted = asked.join(winners, "qid").select("p", "fold", ballots)
    out = [F.col("p")[i].alias(c) for i, c in enumerate(features)]
    out += [F.col("fold").alias(fold)] if fold else []
    return voted.select(*out, F.col("_v.k").alias("k"), F.col("_v.pred").cast(train.schema[label].dataType).alias("pred"))


def knn_classify(
    train: DataFrame, query: DataFrame, features: Sequence[str], label: str, k: int, **sizes
) -> DataFrame:
    """Add the predicted label to every query row; rows with a missing feature get none."""
    votes = knn_votes(train, query, features, label, [k], **sizes).drop("k")
    return query.join(votes, list(features), "left")


def knn_tune(
    train: DataFrame, query: DataFrame, features: Sequence[str], label: str, ks: Sequence[int], **sizes
) -> DataFrame:
    """Accuracy on the query rows for every k; neighbours are searched once for the largest k."""
    votes = knn_votes(train, query, features, label, ks, **sizes)
    return _accuracy_by_k(query, votes, list(features), label)


def _accuracy_by_k(df: DataFrame, votes: DataFrame, on: list[str], label: str) -> DataFrame:
    # Equal points share their prediction, so they are counted before the join.
    counted = df.groupBy(*on, label).agg(F.count(F.lit(1)).alias("_n"))
    right = F.when(F.col(label) == F.col("pred"), F.col("_n")).otherwise(0)
    out = counted.join(votes, on).groupBy("k").agg(F.sum("_n").alias("count"), F.sum(right).alias("correct"))
    return out.withColumn("accuracy", F.col("correct") / F.col("count"))


def knn_cv(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    ks: Sequence[int],
    folds: int = 5,
    scale: bool | Sequence[str] = True,
    keys: Sequence[str] = PLAY,
    seed: int = 15,
    digits: int | None = None,
    **sizes,
) -> DataFrame:
    """Cross-validated accuracy for every k, pooled over the folds.

    ``scale`` z-scores all features, or those named, over the whole table. All
    folds are searched in one pass: a row is no neighbour of its own fold.
    ``digits`` rounds the scaled features, for callers that want near values to tie.
    """
    cols = list(features) if scale is True else list(scale or ())
    rows = cut_lineage(df.select(*dict.fromkeys([*keys, *features, label])))
    if cols:
        rows = zscore(rows, cols)
    if digits is not None:
        rows = rows.withColumns({c: F.round(c, digits) for c in cols})
    rows = kfold(rows, keys, folds, seed)
    votes = knn_votes(rows, rows, features, label, ks, fold="fold", **sizes)
    return _accuracy_by_k(rows, votes, [*features, "fold"], label)


def decision_grid(train: DataFrame, ranges: dict[str, Sequence], label: str, k: int, **sizes) -> DataFrame:
    """Predicted label at every point of a regular grid."""
    grid = value_grid(train.sparkSession, **{c: [float(v) for v in values] for c, values in ranges.items()})
    return knn_classify(train, grid, list(ranges), label, k, **sizes)
