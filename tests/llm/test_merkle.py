"""The distributed manifest against a plain one."""

import hashlib
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from turfline.functions.lineage import _own_folder
from turfline.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, grp string, ord string, digest string, edited string, pos long, block long"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, lowered=False):
    doc_id, text, lang, source, n_chars = row
    if lowered and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    cells = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return h("".join("-" if c is None else f"{len(c.encode())}:{c}" for c in cells))


def reduce_to_one(nodes):
    """The last node and, for every node, its list of (left, right) texts."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, n in enumerate(at):
            run = n // 16 * 16
            paths[i].append(("".join(nodes[run:n]), "".join(nodes[n + 1 : run + 16])))
            at[i] = n // 16
        nodes = [h("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
    return nodes[0], paths


def plain(rows):
    by = {}
    for row in rows:
        by.setdefault(row[3], []).append(row)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subroots, inner = [], []
    for name in names:
        by[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        subroot, paths = reduce_to_one([leaf(r) for r in by[name]])
        subroots.append(subroot)
        inner.append(paths)
    root, upper = reduce_to_one(subroots)
    out = []
    for name, subroot, paths, above in zip(names, subroots, inner, upper):
        for row, path in zip(by[name], paths):
            path = path + above
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            folded = leaf(row, hit)
            for left, right in path:
                folded = h(left + folded + right)
            proof = h("".join(a + b for a, b in path))
            out.append((row[0], leaf(row), subroot, root, proof, folded, folded == root))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "g", "o", "d", "e", 3, 4) for r in rows], SCHEMA).repartition(5)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    leaves = merkle.positions(df, {"text": F.when(hit, merkle.lowered("text")).otherwise(F.col("text"))})
    return leaves, merkle.manifest(leaves)


def check(spark, rows):
    got = sorted([tuple(r) for r in run(spark, rows)[1].collect()], key=str)
    assert got == plain(rows)


def test_many_sources_and_blocks(spark):
    """Two levels of blocks in one source; sources of all sizes, one without a name; keys that are missing or repeated."""
    rows = [(i * 7 % 5003, f"Text Ä {i}", "en", f"s{i % 19}" if i % 3 else "hot", i) for i in range(2500)]
    rows += [(None, f"null {i % 4}", None, None, None) for i in range(40)]
    rows += [(9, "Twice", "de", "hot", 5)] * 3 + [(5000 + i, None, "fr", "ünd", None) for i in range(18)]
    check(spark, rows)
    check(spark, [(i, f"T{i}", "en", "only", 1) for i in range(5000)])


def test_small_tables(spark):
    check(spark, [(1, "One", "en", "a", 3)])
    check(spark, [(i, "X" * 100_000 if i == 3 else "", None, "a", 3) for i in range(17)])
    assert run(spark, [])[1].count() == 0


def test_versions_share_untouched_nodes(spark):
    rows = [(i, f"Text {i}", "en", "a" if i % 2 else "b", i) for i in range(600)]
    leaves, manifest = run(spark, rows)
    copies = merkle.copied_nodes(leaves).collect()
    roots = {r["ord"]: r["folded_root"] for r in manifest.collect()}
    changed = [r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    # 300 leaves a source: three levels to the subroot and one to the root, so five nodes a version.
    assert sorted({c["ord"] for c in copies}) == sorted(changed) and len(copies) == 5 * len(changed)
    assert all(roots[c["ord"]] == c["digest"] for c in copies if c["level"] == 4)


def test_parts_of_the_input_are_not_files(spark):
    """Finding the leaves' places writes files by their number, none for each part of the input, and keeps nothing."""
    folder, held = Path(_own_folder(spark).removeprefix("file:")), spark.sparkContext._jsc.getPersistentRDDs().size()
    before = set(folder.rglob("part-*"))
    df = spark.createDataFrame([(i, f"Text {i}", "en", "a", i, "g", "o", "d", "e", 3, 4) for i in range(300)], SCHEMA).repartition(60)
    leaves = merkle.positions(df, {"text": merkle.lowered("text")})
    assert len(set(folder.rglob("part-*")) - before) < 40
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == held
    assert sorted(r["pos"] for r in leaves.collect()) == list(range(300))


def test_store_keeps_old_versions():
    store = merkle.Store([h(str(i)) for i in range(300)], 3)
    before = list(store.digests)
    tops = [store.put(i, h("new"))[-1] for i in (0, 17, 299)]
    assert store.digests[: len(before)] == before and len(store.digests) == len(before) + 3 * 4
    for at, top in zip((0, 17, 299), tops):
        fresh = merkle.Store([h("new") if i == at else h(str(i)) for i in range(300)], 3)
        assert store.digests[top] == fresh.digests[fresh.top]


@pytest.mark.parametrize("n", [1, 16, 17, 256, 257, 4096])
def test_first_block_stops_at_one_node(n):
    store = merkle._store(0, [h(str(i)) for i in range(n)])
    assert store.digests[store.top] == reduce_to_one([h(str(i)) for i in range(n)])[0]
