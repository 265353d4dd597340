"""N-gram Jaccard join by chosen paths: sets split on sampled shared tokens, small buckets compared, runs repeated."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turfline.functions.lineage import cut_lineage
from turfline.llm import rolling
from turfline.llm.common import table, with_columns
from turfline.llm.components import components

WORDS = 5
THRESHOLD = 0.8
#: Expected tokens that a set chooses per run and level, and the depth of a path.
CHOSEN, LEVELS = 2.0, 3
#: Chance, over all runs, that a pair at the threshold meets even on the deepest paths.
RECALL = 0.9995
#: Buckets up to this size are compared whole; beyond, they are split on further tokens, and on the
#: last level compared in blocks.
BUCKET = 400
#: Sets of a block of such a bucket; a task holds their sketches, a megabyte, and compares them in stripes.
WIDE, STRIPE = 4096, 256
#: Cells of a set's sketch, and the estimated likeness from which a pair is compared exactly: four
#: deviations of the estimate below the threshold.
CELLS, LOOSE = 128, 0.65
#: Sets that one task compares exactly at a time (pairs of such blocks for larger groups).
BLOCK = 256
#: Bits of the map by which texts that nobody asks for are passed over before any text is moved: 2 MB, whatever the input.
MARKS = 1 << 24
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def n_runs(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """Runs until a pair at the threshold is missed with less than 1 - ``recall``, path of full depth."""
    # Fewest choices are common if one set contains the other: at Jaccard t, a share t of the larger.
    meet = (1 - math.exp(-CHOSEN * threshold)) ** LEVELS
    return math.ceil(math.log(1 - recall) / math.log(1 - meet))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words (of ASCII white space); one of all words for shorter texts."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    word = ~_WHITE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).astype(np.int8)))
    if not len(edge):
        return np.zeros(0, np.uint64)
    each = rolling.between(rolling.prefix(data), edge[::2], edge[1::2])
    n = min(words, len(each))
    up, _ = rolling.powers(n + 1)
    gram = sum(each[i : len(each) - n + 1 + i] * up[i] for i in range(n))
    return np.unique(rolling.mix(gram))


def sketch(tokens: np.ndarray) -> np.ndarray:
    """One-permutation min-wise sketch: 16 bits per cell, 65535 where it is empty."""
    out = np.full(CELLS, 65535, np.uint16)
    if not len(tokens):
        return out
    h = rolling.mix(tokens ^ np.uint64(0x5DEECE66D))
    order = np.sort(((h & np.uint64(CELLS - 1)) << np.uint64(57)) | (h >> np.uint64(7)))
    cell = (order >> np.uint64(57)).astype(int)
    first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    out[cell[first]] = ((order[first] & np.uint64(0xFFFFFFFF)) % np.uint64(65535)).astype(np.uint16)
    return out


def paths(tokens: np.ndarray, runs: int) -> list[list[int]]:
    """Tokens that a set chooses, per run and level: those whose hash there is below CHOSEN / size."""
    keys = rolling.mix(np.arange(1, runs * LEVELS + 1, dtype=np.uint64))
    h = (tokens[None] ^ keys[:, None]) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    below = np.uint64(min(CHOSEN / len(tokens), 1.0) * ((1 << 64) - 2048)) if len(tokens) else np.uint64(0)
    at, which = np.nonzero(h <= below)
    chosen = tokens[which].view(np.int64)
    ends = np.searchsorted(at, np.arange(1, runs * LEVELS))
    return [c.tolist() for c in np.split(chosen, ends)]


def _grouped(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[pa.Array]]]:
    """Runs of rows with equal leading key columns, of sorted batches: the key and the other columns."""
    key, parts = None, []
    for batch in batches:
        keys = [np.asarray(batch.column(i)) for i in range(n_keys)]
        if not batch.num_rows:
            continue
        change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        for a, b in zip([0, *change], [*change, batch.num_rows]):
            this = tuple(int(k[a]) for k in keys)
            if this != key and parts:
                yield key, [pa.concat_arrays(c) for c in zip(*parts)]
                parts = []
            key = this
            parts.append([batch.column(i).slice(a, b - a) for i in range(n_keys, batch.num_columns)])
    if parts:
        yield key, [pa.concat_arrays(c) for c in zip(*parts)]


def _stars(ids: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from every set to the least set of its component in a small adjacency matrix."""
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), int)
    rank[order] = np.arange(len(ids))
    label = rank.copy()
    while True:
        new = label.copy()
        for start in range(0, len(ids), STRIPE):
            rows = slice(start, start + STRIPE)
            new[rows] = np.minimum(new[rows], np.where(near[rows], label[None], len(ids)).min(1, initial=len(ids)))
        new = np.minimum(new, new[order[new]])
        if (new == label).all():
            break
        label = new
    linked = label != rank
    return ids[linked], ids[order[label[linked]]]


def _compare_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bucket, links of the pairs whose sketches are alike, as stars."""
    left, right = [], []
    for _, (sid, cells) in _grouped(batches, 1):
        ids = np.asarray(sid)
        x = np.frombuffer(b"".join(cells.to_pylist()), np.uint16).reshape(len(ids), CELLS).T.copy()
        void = x == 65535
        near = np.empty((len(ids), len(ids)), bool)
        for start in range(0, len(ids), STRIPE):
            rows = slice(start, start + STRIPE)
            alike = np.zeros(near[rows].shape, np.int16)
            empty = np.zeros(near[rows].shape, np.int16)
            for c in range(CELLS):
                alike += x[c, rows, None] == x[c][None]
                if void[c].any():
                    empty += void[c, rows, None] & void[c][None]
            near[rows] = alike - empty >= LOOSE * np.maximum(CELLS - empty, 1)
        np.fill_diagonal(near, False)
        a, b = _stars(ids, near)
        left.append(a)
        right.append(b)
        if sum(map(len, left)) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])
            left, right = [], []
    if left:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])


def _common(x: list[np.ndarray], n_left: int) -> np.ndarray:
    """Sizes of the intersections of the first ``n_left`` sets with the rest (or with all, if it is all)."""
    sizes = np.array([len(t) for t in x])
    tokens, inverse, counts = np.unique(np.concatenate(x), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(x)), sizes)
    shared = counts[inverse] > 1  # a token of one set adds to no intersection
    column = (np.cumsum(counts > 1) - 1)[inverse]
    row, column = row[shared], column[shared]
    width = int((counts > 1).sum())
    right = slice(0, n_left) if n_left == len(x) else slice(n_left, None)
    out = np.zeros((n_left, n_left if n_left == len(x) else len(x) - n_left), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for start in range(0, width, 4096):
        a, b = np.searchsorted(column, [start, start + 4096])
        held = np.zeros((len(x), min(4096, width - start)), np.float32)
        held[row[a:b], column[a:b] - start] = 1
        out += held[:n_left] @ held[right].T
    return out


def _compare_sets(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), (sid, copies, side, sets) in _grouped(batches, 3):
            ids, weight, side = np.asarray(sid), np.asarray(copies), np.asarray(side)
            order = np.argsort(side, kind="stable")
            ids, weight, side = ids[order], weight[order], side[order]
            given = sets.to_pylist()
            x = [np.frombuffer(given[o], np.uint64) for o in order]
            n = len(ids) if i == j else int((side == 0).sum())
            if n == 0 or (i != j and n == len(ids)):
                continue
            both = _common(x, n)
            size = np.array([len(t) for t in x], float)
            other = size[:n] if i == j else size[n:]
            link = both >= threshold * (size[:n, None] + other[None] - both) - 1e-6
            near = np.zeros((len(ids), len(ids)), bool)
            if i == j:
                np.fill_diagonal(link, False)
                near = link
            else:
                near[:n, n:] = link
                near[n:, :n] = link.T
            n_links = near @ weight
            hit = n_links > 0
            a, b = _stars(ids, near)
            root = dict(zip(a.tolist(), b.tolist()))
            ids, n_links = ids[hit], n_links[hit]
            roots = np.array([root.get(s, s) for s in ids.tolist()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(roots), pa.array(n_links.astype(np.int64))], names=["sid", "root", "n"])

    return run


def _small_buckets(met: DataFrame) -> DataFrame:
    """Member lists of the buckets that are compared whole."""
    return met.where(F.col("n") <= BUCKET).groupBy("path").agg(F.array_sort(F.collect_set("sid")).alias("members")).select("members")


def _sized(rows: DataFrame) -> DataFrame:
    """Rows of the buckets of two sets or more, with the size ``n``."""
    sizes = cut_lineage(rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    return rows.join(sizes, "path")


def _candidates(sets: DataFrame, runs: int) -> DataFrame:
    """Links ``a`` - ``b`` that connect all sets which meet in a bucket and have sketches alike.

    Level by level, sets with a common path are in one bucket. One that is too
    large goes on to the next level: its sets join the buckets of the tokens
    that they choose there. Buckets that are large on the last level hold near
    copies of one text or users of one passage; they are compared in pairs of
    blocks of WIDE sets.
    """
    cells = sets.select("sid", "cells")
    compared = []
    first = sets.select("sid", F.posexplode(F.slice("chosen", 1, runs)).alias("run", "tokens")).select("sid", "run", F.explode("tokens").alias("token"))
    rows = first.select("sid", "run", F.xxhash64("run", "token").alias("path"))
    for level in range(1, LEVELS + 1):
        met = _sized(cut_lineage(rows))
        compared.append(_small_buckets(met))
        large = met.where(F.col("n") > BUCKET)
        if level < LEVELS:
            chosen = sets.select("sid", F.posexplode(F.slice("chosen", level * runs + 1, runs)).alias("run", "tokens"))
            rows = large.select("sid", "run", "path").join(chosen, ["sid", "run"]).select("sid", "run", "path", F.explode("tokens").alias("token"))
            rows = rows.select("sid", "run", F.xxhash64("path", "token").alias("path"))
    small = compared[0]
    for more in compared[1:]:
        small = small.union(more)
    # Runs find the same groups again and again; each is compared once.
    small = small.where(F.size("members") > 1).distinct().select(F.xxhash64("members").alias("bucket"), F.explode("members").alias("sid"))
    n_blocks = F.ceil(F.col("n") / WIDE).cast("int")
    spread = large.withColumn("block", F.pmod(F.xxhash64("sid", F.lit(6)), n_blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    wide = spread.select(F.xxhash64("path", F.least("block", "other"), F.greatest("block", "other")).alias("bucket"), "sid")
    sketched = small.union(wide).join(cells, "sid").select("bucket", "sid", "cells")
    return sketched.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_compare_sketches, "a long, b long")


def _asked(rows: DataFrame, hashes: DataFrame) -> DataFrame:
    """The rows whose hash ``th`` is in ``hashes``, and few others: those whose bit in a map of MARKS bits is set too.

    No row of ``rows`` is moved. The join that follows decides; with very many hashes it only has more to do.
    """
    at = F.pmod(F.col("th"), F.lit(MARKS)) + 1
    place = F.bitmap_bucket_number(at), F.bitmap_bit_position(at)
    bits = hashes.select(place[0].alias("__map"), place[1].alias("__bit")).repartition("__map")
    maps = bits.groupBy("__map").agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    byte = F.conv(F.hex(F.substring("__bits", F.floor(place[1] / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = rows.join(F.broadcast(maps), place[0] == F.col("__map"))
    return met.where(F.getbit(byte, (place[1] % 8).cast("int")) == 1).select(*rows.columns)


def _texts(slim: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts ``t`` of ``slim`` that the rows of ``wanted`` come from; most texts are in no group and stay where they are.

    Rows without a key are found by their text's hash; a text among them is read once. The joins are inner ones to
    distinct keys: a semi join would be pushed below the map of ``_asked``, and then move all texts.
    """
    asked = _asked(slim, wanted.select("th"))
    keyed = asked.join(wanted.where("k is not null").select("k", "th").distinct(), ["k", "th"])
    others = asked.where("k is null").join(wanted.where("k is null").select("th").distinct(), "th")
    return keyed.select("t").union(others.select("t").distinct())


def join(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: the key, ``class_id`` and ``n_links``.

    ``n_links`` counts the other documents whose sets of word n-grams have a
    Jaccard likeness of ``threshold`` or more; ``class_id`` is the least key of
    the documents connected by links. Documents with equal sets are one set
    with a weight, so copies are never expanded. A text shorter than ``words``
    words has one n-gram of all its words; null, empty and white texts have
    none, link to nothing and are classes of their own. Rows without a key are
    linked like others; the class of documents that all lack it is null.

    Sets are split along chosen paths (``_candidates``), the sets of a bucket are
    compared by sketches, and groups of sets that sketches connect are compared
    exactly, in blocks. No pair is written: a block gives the number of links
    of each set and a star that connects the linked ones.
    """
    return _linked(docs, text, key, words, threshold).select(F.col("k").alias(key), "class_id", "n_links")


def _linked(docs: DataFrame, text: str, key: str, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """As ``join``: ``k``, ``th`` (hash of the text), ``class_id``, ``n_links`` and ``root``, the class by number (null for empty sets)."""
    runs = n_runs(threshold)

    def described():
        def of(texts):
            out = ([], [], [], [])
            for t in texts:
                tokens = shingles(t, words)
                chosen = paths(tokens, runs)
                a, b = (int(x) for x in _content(tokens))
                # Levels outermost: the runs of one level stand together.
                by_level = [chosen[r * LEVELS + level] for level in range(LEVELS) for r in range(runs)]
                for o, v in zip(out, ([a, b], len(tokens), sketch(tokens).tobytes(), by_level)):
                    o.append(v)
            return out

        return of

    slim = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.xxhash64(F.col(text)).alias("th"))
    rows = with_columns(slim, ["t"], described, "content array<long>, size int, cells binary, chosen array<array<long>>")
    rows = cut_lineage(rows.drop("t").withColumns({"c0": F.col("content")[0], "c1": F.col("content")[1]}).drop("content"))
    full = rows.where("size > 0")
    groups = full.groupBy("c0", "c1").agg(F.min(F.struct(F.col("k").isNull().alias("no"), "k", "th")).alias("f"), F.count(F.lit(1)).alias("copies"), F.first(F.struct("cells", "chosen")).alias("s"))
    sets = cut_lineage(groups.select(F.monotonically_increasing_id().alias("sid"), "c0", "c1", F.col("f.k").alias("first"), "f.th", "copies", "s.*"))
    groups = components(cut_lineage(_candidates(sets, runs).distinct()))
    # The sets themselves, of the sets that are in a group only: from the text of their first document.
    wanted = sets.join(groups, F.col("sid") == F.col("node")).select("sid", "c0", "c1", "copies", "root", F.col("first").alias("k"), "th")
    wanted = cut_lineage(wanted)

    def tokens_of():
        def of(texts):
            found = [shingles(t, words) for t in texts]
            content = [_content(t) for t in found]
            return [int(c[0]) for c in content], [int(c[1]) for c in content], [t.tobytes() for t in found]

        return of

    texts = _texts(slim, wanted)
    listed = with_columns(texts, ["t"], tokens_of, "c0 long, c1 long, tokens binary").drop("t").dropDuplicates(["c0", "c1"])
    sized = wanted.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = wanted.join(sized, "root").join(listed, ["c0", "c1"])
    placed = placed.withColumn("block", F.pmod(F.xxhash64("sid", F.lit(6)), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    side = F.when(low == high, F.lit(0)).otherwise((F.col("block") == high).cast("int"))
    keyed = placed.select("root", low.alias("i"), high.alias("j"), "sid", "copies", side.alias("side"), "tokens")
    exact = keyed.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(_compare_sets(threshold), "sid long, root long, n long")
    exact = cut_lineage(exact)
    counted = exact.groupBy("sid").agg(F.sum("n").alias("n"))
    joined = components(exact.where("sid != root").select(F.col("sid").alias("a"), F.col("root").alias("b")))
    named = sets.join(joined, F.col("sid") == F.col("node"), "left").select("sid", "c0", "c1", "first", "copies", F.coalesce("root", "sid").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("class_id"))
    classes = named.join(least, "root").join(counted, "sid", "left").select("c0", "c1", "root", "class_id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    empty = rows.where("size = 0").select("k", "th", F.col("k").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("root"))
    return full.select("k", "th", "c0", "c1").join(classes, ["c0", "c1"]).select("k", "th", "class_id", "n_links", "root").union(empty)


def _content(tokens: np.ndarray) -> np.ndarray:
    """Two independent hashes of a whole set, as signed integers."""
    with np.errstate(over="ignore"):
        a = rolling.mix(rolling.mix(tokens ^ np.uint64(17)).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(tokens)))
        b = rolling.mix(rolling.mix(tokens ^ np.uint64(91)).sum(keepdims=True, dtype=np.uint64) ^ np.uint64(len(tokens)))
    return np.concatenate([a, b]).view(np.int64)


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of every class of near-duplicates the document with the least id stays, one row of it.

    Of a class without any id one row stays; rows without id and words are classes of their own.
    """
    found = cut_lineage(_linked(docs.select("doc_id", "text"), "text", "doc_id"))
    kept = found.where(F.col("k") == F.col("class_id")).select(F.col("k").alias("doc_id")).distinct()
    # Rows that repeat the id and the text of a kept document are copies too.
    again = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.xxhash64(*docs.columns)))
    named = docs.join(kept, "doc_id", "left_semi")
    lone = found.where(F.col("k").isNull() & F.col("class_id").isNull())
    one = lone.where("root is not null").groupBy("root").agg(F.min("th").alias("__th")).select("__th")
    bare = docs.where(F.col("doc_id").isNull()).withColumn("__th", F.xxhash64("text"))
    single = bare.join(one, "__th", "left_semi").select(*docs.columns)
    empty = bare.join(lone.where("root is null").select(F.col("th").alias("__th")).distinct(), "__th", "left_semi").select(*docs.columns)
    out = named.select(*docs.columns).union(single).withColumn("__n", again).where("__n = 1").select(*docs.columns)
    return out.union(empty)
