"""Merkle manifest of a table as a persistent tree: a changed row makes a version that shares all untouched nodes.

The rows of a group (a source) are leaves in key order. Sixteen consecutive
nodes become their digest, level by level, until one is left: the subroot. The
subroots, in group order, are reduced alike to the root.

Leaves get their position by ranges of group and key, so a group of any size is
spread. Aligned blocks of 4,096 nodes are three whole levels: every block is one
small task group that keeps its nodes in a store, and the tops of the blocks are
the nodes of the next, distributed stage. What a block needs of the stages above
is the siblings on its way to the root, a few kilobytes. They come back down,
again block by block, and each changed leaf makes its version: its ancestors in
the block are copied in the store, all other nodes are shared, and the copy goes
on along the siblings above to the version's root.

Nulls: a missing value is digested as ``-``; a missing group is one of its own
and comes first; rows without key come first in their group. Rows with equal
keys are ordered by digest, equal rows are interchangeable. An empty table has
an empty manifest. Columns not named in ``columns`` are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turfline.functions.lineage import cut_lineage
from turfline.functions.skew import running_total
from turfline.llm.common import table

FAN = 16
#: Whole levels inside a block, and the nodes that make one.
LEVELS = 3
BLOCK = FAN**LEVELS
#: Blocks that a task handles, about a quarter of a million leaves.
BLOCKS_PER_TASK = 64
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

_PATH = "grp string, pos bigint, path array<string>, subroot string, root string"
_PROOF = "ord string, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
_COPIES = "ord string, level int, node bigint, digest string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def framed(values: Sequence[Column]) -> Column:
    """SHA-256 of the values, each as byte count, colon and text, or ``-`` for a missing one."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


class Store:
    """Nodes of one block. Nodes are only ever added; a version is the number of its top node."""

    def __init__(self, digests: Sequence[str], levels: int):
        self.digests = list(digests)
        self.children: list[tuple[int, ...]] = [()] * len(self.digests)
        self.levels = levels
        layer = list(range(len(self.digests)))
        for _ in range(levels):
            layer = [self._join(tuple(layer[i : i + FAN])) for i in range(0, len(layer), FAN)]
        self.top = layer[0]

    def _add(self, text: str, kids: tuple[int, ...]) -> int:
        self.digests.append(text)
        self.children.append(kids)
        return len(self.digests) - 1

    def _join(self, kids: tuple[int, ...]) -> int:
        return self._add(digest("".join([self.digests[k] for k in kids])), kids)

    def way(self, slot: int) -> list[tuple[tuple[int, ...], int]]:
        """Children of every ancestor of a leaf and the place taken among them, bottom up."""
        node, found = self.top, []
        for level in range(self.levels - 1, -1, -1):
            kids, at = self.children[node], slot // FAN**level % FAN
            found.append((kids, at))
            node = kids[at]
        return found[::-1]

    def siblings(self, slot: int) -> list[str]:
        """Digests left and right of the leaf's way, two texts per level."""
        out = []
        for kids, at in self.way(slot):
            out += ["".join([self.digests[k] for k in kids[:at]]), "".join([self.digests[k] for k in kids[at + 1 :]])]
        return out

    def put(self, slot: int, text: str) -> list[int]:
        """The leaf and the ancestors of the version in which leaf ``slot`` has another digest, bottom up."""
        copies = [self._add(text, ())]
        for kids, at in self.way(slot):
            copies.append(self._join((*kids[:at], copies[-1], *kids[at + 1 :])))
        return copies


def _store(block: int, digests: Sequence[str]) -> Store:
    """A first block stops at one node; later ones go up all levels, as their group has more nodes."""
    levels = LEVELS
    if block == 0:
        levels, width = 0, len(digests)
        while width > 1:
            width, levels = -(-width // FAN), levels + 1
    return Store(digests, levels)


def fold(text: str, path: Sequence[str]) -> str:
    """Digest at the end of a path of left and right siblings."""
    for left, right in zip(path[::2], path[1::2]):
        text = digest(left + text + right)
    return text


def _blocks(nodes: DataFrame, tasks: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / BLOCK)).repartition(tasks, "grp", "block")


def _tasks(n_nodes: int) -> int:
    return max(1, -(-n_nodes // (BLOCK * BLOCKS_PER_TASK)))


def _tops(nodes: DataFrame, tasks: int) -> DataFrame:
    """The top of every block, as a node of the next stage."""

    def top(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        store = _store(key[1], rows.sort_values("pos")["digest"].tolist())
        return pd.DataFrame({"grp": [key[0]], "pos": [key[1]], "digest": [store.digests[store.top]]})

    return _blocks(nodes.select("grp", "pos", "digest"), tasks).groupBy("grp", "block").applyInPandas(top, "grp string, pos bigint, digest string")


def _climb(nodes: DataFrame) -> tuple[list[tuple[DataFrame, int]], DataFrame]:
    """Stages from ``nodes`` (``grp, pos, digest``) on, each with its number of tasks, and the single node of each group."""
    stages = []
    while True:
        size, last = nodes.agg(F.count(F.lit(1)), F.max("pos")).first()
        if not last:
            return stages, nodes
        stages.append((nodes, _tasks(size)))
        nodes = cut_lineage(_tops(nodes, stages[-1][1]))


def _descend(nodes: DataFrame, above: DataFrame, tasks: int) -> DataFrame:
    """Paths of all nodes of a stage from the paths of the tops of their blocks."""

    def paths(key: tuple, rows: pd.DataFrame, tops: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        store, top = _store(key[1], rows["digest"].tolist()), tops.iloc[0]
        found = [[*store.siblings(i), *top["path"]] for i in range(len(rows))]
        return pd.DataFrame({"grp": key[0], "pos": rows["pos"], "path": found, "subroot": top["subroot"], "root": top["root"]})

    left = _blocks(nodes.select("grp", "pos", "digest"), tasks).groupBy("grp", "block")
    right = above.withColumnRenamed("pos", "block").repartition(tasks, "grp", "block").groupBy("grp", "block")
    return left.cogroup(right).applyInPandas(paths, _PATH)


def positions(
    df: DataFrame,
    changed: Mapping[str, Column],
    columns: Sequence[str] = COLUMNS,
    group: str = "source",
    order: str = "doc_id",
) -> DataFrame:
    """Leaves: group, key, digest, digest after the change (null if it stays) and position in the group.

    Only digests and keys go on from here; the texts are read once. What is read
    twice of them, to find the ranges and to move the rows, waits as blocks on
    the executors' disks and not as a file for every part of the input: for
    each file it makes, Hadoop starts processes beside the executor.
    """
    sound = framed([F.col(f"`{c}`") for c in columns])
    edited = framed([changed[c] if c in changed else F.col(f"`{c}`") for c in columns])
    named = F.concat(F.when(F.col(f"`{group}`").isNull(), "-").otherwise("="), F.coalesce(F.col(f"`{group}`").cast("string"), F.lit("")))
    leaves = df.select(
        named.alias("grp"),  # a missing group sorts first
        F.col(f"`{order}`").alias("ord"),
        F.unhex(sound).alias("digest"),
        F.unhex(F.nullif(edited, sound)).alias("edited"),
    )
    # The key tells equal rows apart, so that copies of one row can be spread.
    held = leaves.withColumn("key", F.monotonically_increasing_id()).persist(StorageLevel.DISK_ONLY)
    try:
        placed = running_total(held.withColumn("tie", F.substring("digest", 1, 8)), ["grp"], ["ord", "tie", "key"], F.lit(1), "pos")
    finally:
        held.unpersist()
    return cut_lineage(placed.drop("tie"))


def _above(leaves: DataFrame) -> tuple[DataFrame, int]:
    """Paths of the tops of all blocks of leaves, and the number of tasks of the lowest stage."""
    size = leaves.count()
    tasks = _tasks(size)
    plain = leaves.select("grp", "pos", F.lower(F.hex("digest")).alias("digest"))
    stages, subroots = _climb(cut_lineage(_tops(plain, tasks)))
    ordered = cut_lineage(running_total(subroots.select("grp", "digest", F.lit("*").alias("all")), ["all"], ["grp"], F.lit(1), "at"))
    upper, root = _climb(ordered.select(F.col("all").alias("grp"), F.col("at").alias("pos"), "digest"))
    nothing, no_text = F.array().cast("array<string>"), F.lit(None).cast("string")
    paths = root.select("grp", "pos", nothing.alias("path"), no_text.alias("subroot"), F.col("digest").alias("root"))
    for nodes, n in reversed(upper):
        paths = _descend(nodes, paths, n)
    paths = paths.select(F.col("pos").alias("at"), "path", "root").join(ordered, "at")
    paths = cut_lineage(paths.select("grp", F.lit(0).cast("bigint").alias("pos"), "path", F.col("digest").alias("subroot"), "root"))
    for nodes, n in reversed(stages):
        paths = cut_lineage(_descend(nodes, paths, n))
    return paths, tasks


def _by_block(leaves: DataFrame, above: DataFrame, tasks: int):
    rows = leaves.select("grp", "pos", F.col("ord").cast("string"), "digest", "edited")
    tops = above.withColumnRenamed("pos", "block").repartition(tasks, "grp", "block")
    return _blocks(rows, tasks).groupBy("grp", "block").cogroup(tops.groupBy("grp", "block"))


def _versions(key: tuple, rows: pd.DataFrame) -> Iterator[tuple[int, Store, bytes | None]]:
    """Store and changed digest for every leaf of a block, in order."""
    store = _store(key[1], [d.hex() for d in rows["digest"]])
    for slot, edited in enumerate(rows["edited"]):
        yield slot, store, edited


def manifest(leaves: DataFrame) -> DataFrame:
    """Per leaf: its digest, subroot and root of the sound table, digest of its proof, and the root of its version.

    ``folded_root`` is the root of the tree in which this leaf alone has its
    changed digest; for a leaf that stays it is folded from the leaf and its
    siblings too, so it checks the proof.
    """
    above, tasks = _above(leaves)

    def prove(key: tuple, rows: pd.DataFrame, tops: pd.DataFrame) -> pd.DataFrame:
        rows, top = rows.sort_values("pos"), tops.iloc[0]
        path = list(top["path"])
        proofs, roots = [], []
        for slot, store, edited in _versions(key, rows):
            beside = store.siblings(slot)
            proof = hashlib.sha256("".join(beside).encode())
            proof.update("".join(path).encode())
            proofs.append(proof.hexdigest())
            if edited is None:
                roots.append(fold(fold(store.digests[slot], beside), path))
            else:
                roots.append(fold(store.digests[store.put(slot, edited.hex())[-1]], path))
        return pd.DataFrame(
            {
                "ord": rows["ord"], "leaf": [d.hex() for d in rows["digest"]], "subroot": top["subroot"], "root": top["root"],
                "proof_sha256": proofs, "folded_root": roots,
            }
        )

    proofs = _by_block(leaves, above, tasks).applyInPandas(prove, _PROOF)
    key = F.col("ord").cast(leaves.schema["ord"].dataType)
    return proofs.withColumn("ord", key).withColumn("verified", F.col("folded_root") == F.col("root"))


def copied_nodes(leaves: DataFrame) -> DataFrame:
    """The nodes that the version of every changed leaf owns; it shares all others with the sound tree.

    ``level`` counts from the leaf up to the root over all stages, ``node`` is
    the place of the copied node in its level of the block.
    """
    above, tasks = _above(leaves)

    def copies(key: tuple, rows: pd.DataFrame, tops: pd.DataFrame) -> pd.DataFrame:
        rows, path = rows.sort_values("pos"), list(tops.iloc[0]["path"])
        keys, out = rows["ord"].tolist(), []
        for slot, store, edited in _versions(key, rows):
            if edited is None:
                continue
            own = [store.digests[c] for c in store.put(slot, edited.hex())]
            for i in range(0, len(path), 2):
                own.append(fold(own[-1], path[i : i + 2]))
            out += [(keys[slot], level, slot // FAN**level, text) for level, text in enumerate(own)]
        return pd.DataFrame(out, columns=["ord", "level", "node", "digest"])

    found = _by_block(leaves, above, tasks).applyInPandas(copies, _COPIES)
    return found.withColumn("ord", F.col("ord").cast(leaves.schema["ord"].dataType))


def lowered(column: str) -> Column:
    """Text with A-Z, and no other letter, in lower case."""
    upper = "".join(chr(c) for c in range(ord("A"), ord("Z") + 1))
    return F.translate(F.col(f"`{column}`"), upper, upper.lower())


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root, proof and version of every document; every fifth document by checksum is lower-cased."""
    docs = table(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    leaves = positions(docs, {"text": F.when(hit, lowered("text")).otherwise(F.col("text"))})
    return manifest(leaves).select(
        F.col("ord").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"
    )
