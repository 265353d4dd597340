"""Mixing sources to target weights: block quotas split among output shards by a hypergeometric tree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turfline.functions.lineage import cut_lineage
from turfline.llm.common import table

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: A source gives at most so many times its own size.
MOST_PASSES = 3
BLOCK_WORDS = 8192
SHARD_WORDS = 1 << 20
#: Blocks whose running totals are taken in one window.
PIECE_BLOCKS = 1000


def n_words(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """Add ``target`` to a table of ``src`` and ``source_size``: shares by weight, stopped at ``most`` sizes.

    One row per source passes through one window, which ranks the names; null
    comes last. The excess of stopped sources is reshared by weight until none
    is above; every round is one aggregate and stops at least one more source.
    """
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("src"))) - 1
    weighted = cut_lineage(sources.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))))
    stop = F.col("source_size") * float(most)
    total, w = weighted.agg(F.sum("source_size"), F.sum("w")).first()
    level, last = (float(total or 0) / w if w else 0.0), None
    while level != last:
        capped = stop <= F.col("w") * level
        held, free = weighted.agg(F.sum(F.when(capped, stop)), F.sum(F.when(~capped, F.col("w")))).first()
        level, last = ((float(total or 0) - (held or 0.0)) / free if free else level), level
    return weighted.withColumn("target", F.least(stop, F.col("w") * level)).drop("w")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` worked out once and named, however often ``use`` mentions it."""
    return F.transform(F.array(value), use)[0]


def _hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """Marked items among ``drawn`` of ``total``, by inverting the distribution at ``u``.

    The terms within twelve deviations of the mode are summed by their ratio;
    what lies beyond has less than 1e-30 of the mass.
    """
    # Every value is bound to a name before the next is made from it: in place, the tree of expressions of one draw holds
    # each of them dozens of times, and the driver keeps and prints such a tree for every level.
    given = F.struct(total.cast("double").alias("big"), marked.cast("double").alias("k"), drawn.cast("double").alias("n"))

    def bounds(v: Column) -> Column:
        big, k, n = v["big"], v["k"], v["n"]
        far = F.ceil(12 * F.sqrt(F.greatest(n * k / big * (1 - k / big) * (big - n) / F.greatest(big - 1, F.lit(1.0)), F.lit(0.0)))).cast("double") + 2
        return F.struct(
            big.alias("big"), k.alias("k"), n.alias("n"), F.greatest(F.lit(0.0), n + k - big).alias("low"), F.least(n, k).alias("high"),
            F.floor((n + 1) * (k + 1) / (big + 2)).cast("double").alias("mode"), far.alias("far"),
        )

    def ends(v: Column) -> Column:
        a, b = F.greatest(v["low"], v["mode"] - v["far"]), F.least(v["high"], v["mode"] + v["far"])
        return F.struct(v["big"].alias("big"), v["k"].alias("k"), v["n"].alias("n"), a.alias("a"), b.alias("b"))

    def walk(v: Column, goal: Column) -> Column:
        big, k, n = v["big"], v["k"], v["n"]
        steps = F.sequence(F.lit(0).cast("bigint"), (v["b"] - v["a"]).cast("bigint"))
        start = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum"), F.lit(-1).cast("bigint").alias("at"))

        def step(s: Column, i: Column) -> Column:
            def moved(x: Column) -> Column:
                upto = s["sum"] + s["p"]
                return F.struct(
                    (s["p"] * (k - x) * (n - x) / ((x + 1) * F.greatest(big - k - n + x + 1, F.lit(1.0)))).alias("p"),
                    upto.alias("sum"),
                    F.when((s["at"] < 0) & (upto >= goal), x.cast("bigint")).otherwise(s["at"]).alias("at"),
                )

            return _bound(v["a"] + i.cast("double"), moved)

        return F.aggregate(steps, start, step)

    def found(v: Column) -> Column:
        at = _bound(walk(v, F.lit(float("inf")))["sum"] * u, lambda goal: walk(v, goal)["at"])
        return F.coalesce(F.nullif(at, F.lit(-1).cast("bigint")), v["b"].cast("bigint"))

    drawn_from = _bound(given, lambda v: _bound(bounds(v), lambda w: _bound(ends(w), found)))
    none = (total <= 0) | (marked <= 0) | (drawn <= 0)
    return F.when(none, F.lit(0).cast("bigint")).otherwise(drawn_from)


def split_quotas(quotas: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """Split exact block quotas (``src_no``, ``quota``) among shards: ``src_no``, ``shard``, ``quota``.

    A node of the tree holds a range of shards and the quotas of all sources.
    It gives its left half of the shards the left share of its blocks, drawn
    without replacement: one hypergeometric draw per source, each from what
    the sources before it left. One row per node holds one number per source.
    """
    u = lambda lo, hi, i: (F.pmod(F.xxhash64(F.lit(seed), lo, hi, i), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    tree = quotas.agg(F.transform(F.array_sort(F.collect_list(F.struct("src_no", "quota"))), lambda s: s.quota).alias("q"))
    tree = tree.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "q")
    width = shards
    while width > 1:
        lo, hi, q = F.col("lo"), F.col("hi"), F.col("q")
        total = F.aggregate(q, F.lit(0).cast("bigint"), lambda s, x: s + x)
        mid = (lo + F.floor((hi - lo + 1) / 2)).cast("int")
        left_n = F.floor(total * (mid - lo) / (hi - lo)).cast("bigint")
        start = F.struct(total.alias("rest"), left_n.alias("left"), F.array().cast("array<bigint>").alias("out"))

        def take(s: Column, x: Column) -> Column:
            got = _hypergeometric(s["rest"], x, s["left"], u(F.col("lo"), F.col("hi"), F.size(s["out"])))
            both = F.transform(F.array(got), lambda g: F.struct((s["rest"] - x).alias("rest"), (s["left"] - g).alias("left"), F.concat(s["out"], F.array(g)).alias("out")))
            return both[0]

        node = tree.withColumn("l", F.when(hi - lo > 1, F.aggregate(q, start, take)["out"])).withColumn("mid", mid)
        right = F.zip_with("q", "l", lambda x, y: x - y)
        two = F.array(F.struct(lo.alias("lo"), F.col("mid").alias("hi"), F.col("l").alias("q")), F.struct(F.col("mid").alias("lo"), hi.alias("hi"), right.alias("q")))
        one = F.array(F.struct(lo.alias("lo"), hi.alias("hi"), q.alias("q")))
        tree = node.select(F.explode(F.when(hi - lo > 1, two).otherwise(one)).alias("n")).select("n.*")
        width = (width + 1) // 2
    return tree.select(F.col("lo").alias("shard"), F.posexplode("q").alias("src_no", "quota"))


def _running(blocks: DataFrame) -> DataFrame:
    """Add ``pos`` and ``before`` (blocks and words ahead) in the permuted order of each source's blocks.

    The order is cut into pieces, so one source may have any number of blocks.
    """
    share = F.shiftrightunsigned(F.xxhash64("src", "block", F.lit(4)), 11).cast("double") / float(1 << 53)
    placed = blocks.withColumn("u", share).withColumn("piece", F.floor(F.col("u") * F.ceil(F.col("n_blocks") / PIECE_BLOCKS)))
    placed = cut_lineage(placed)
    inside = Window.partitionBy("src", "piece").orderBy("u", "block")
    ahead = Window.partitionBy("src").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = placed.groupBy("src", "piece").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("w"))
    pieces = pieces.select("src", "piece", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n0"), F.coalesce(F.sum("w").over(ahead), F.lit(0)).alias("w0"))
    ranked = placed.withColumns({"r": F.row_number().over(inside) - 1, "s": F.sum("words").over(inside) - F.col("words")})
    same = ranked["src"].eqNullSafe(pieces["src"]) & (ranked["piece"] == pieces["piece"])
    return ranked.join(pieces, same).select(*[ranked[c] for c in blocks.columns], (F.col("r") + F.col("n0")).alias("pos"), (F.col("s") + F.col("w0")).alias("before"))


def draw(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", seed: int = 0,
         block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``size``, ``source_size``, ``target`` and ``draws``, the (pass, shard) of every copy the mix takes.

    Rows of a source are hashed into blocks of about ``block_words`` words. A
    source gives whole passes over its blocks, then the blocks at the head of
    its permuted order, and of the block that its target ends in the rows up
    to that word. Slots (pass and position) are dealt to the shards in the
    numbers that ``split_quotas`` draws, so shards hold disjoint runs of them.
    A row is taken ``MOST_PASSES`` times at most. Null sources are a source of
    their own; null and empty texts have size 0 and change nothing. All
    choices are hashes: reruns agree, and equal rows share their block.
    """
    spark = docs.sparkSession
    row_hash = F.xxhash64(F.col(key), F.col(text), F.lit(seed))
    full = docs.withColumns({"__src": F.col(source), "__size": n_words(F.col(text)), "__h": row_hash})
    if keep is not None:  # few columns: written once and read for all that follows
        full = cut_lineage(full.select(*keep, "__src", "__size", "__h"))
    rows = full.select(F.col("__src").alias("src"), F.col("__size").alias("size"), F.col("__h").alias("h"))
    if keep is None:
        rows = cut_lineage(rows)
    sources = targets(rows.groupBy("src").agg(F.sum("size").alias("source_size")))
    n_blocks = F.greatest(F.ceil(F.col("source_size") / block_words), F.lit(1)).cast("bigint")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    sources = cut_lineage(sources.withColumns({"n_blocks": n_blocks, "passes": passes}))
    block = F.pmod(F.shiftright("h", 8), F.col("n_blocks")).alias("block")

    def by_source(df: DataFrame, *more: str) -> DataFrame:
        s = sources.select(F.col("src").alias("__src"), *more)
        return df.join(s, df["src"].eqNullSafe(s["__src"])).drop("__src")

    placed = by_source(rows, "n_blocks").select("src", "size", "h", "n_blocks", block)
    blocks = placed.groupBy("src", "block", "n_blocks").agg(F.sum("size").alias("words")).where("words > 0")
    # Hashing may leave a block empty; the positions count the blocks that are there.
    ordered = cut_lineage(by_source(_running(blocks), "source_size", "target", "passes"))
    rest = F.col("target") - F.col("passes") * F.col("source_size")
    there = ordered.groupBy("src").agg(F.count(F.lit(1)).alias("n_there"))
    extra = (F.col("before") < rest).cast("int")
    takes = ordered.select("src", "block", "pos", "words", "passes", (F.col("passes") + extra).alias("times"), F.when((extra == 1) & (F.col("before") + F.col("words") > rest), rest - F.col("before")).alias("need"))
    takes = takes.join(there.withColumnRenamed("src", "__s"), F.col("src").eqNullSafe(F.col("__s"))).drop("__s")
    # Of the block in which the target ends: rows in the order of their hashes, as long as the middle of the row is before the end.
    ends = takes.where(F.col("need").isNotNull()).select(F.col("src").alias("__s"), F.col("block").alias("__b"), "need")
    upto = F.sum("size").over(Window.partitionBy("src", "block").orderBy("h"))
    cut = placed.join(ends, F.col("src").eqNullSafe(F.col("__s")) & (F.col("block") == F.col("__b"))).withColumn("upto", upto)
    cut = cut.where(F.col("upto") - F.col("size") / 2 <= F.col("need")).groupBy("__s", "__b").agg(F.max("h").alias("cut_h"))
    # Quotas, the tree, and the slots of every shard.
    names = sources.select("src").withColumn("src_no", (F.row_number().over(Window.orderBy(F.asc_nulls_last("src"))) - 1).cast("int"))
    names = cut_lineage(names)
    quotas = takes.groupBy("src").agg(F.sum("times").cast("bigint").alias("quota"))
    numbered = names.join(quotas.withColumnRenamed("src", "__s"), F.col("src").eqNullSafe(F.col("__s")), "left").select("src_no", F.coalesce("quota", F.lit(0)).cast("bigint").alias("quota"))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    shards = max(1, -(-total // shard_words))
    leaves = cut_lineage(split_quotas(numbered, shards, seed))
    upto_shard = Window.partitionBy("src_no").orderBy("shard")
    runs = leaves.withColumn("end", F.sum("quota").over(upto_shard)).where("quota > 0")
    slots = runs.select("src_no", "shard", F.explode(F.sequence(F.col("end") - F.col("quota"), F.col("end") - 1)).alias("slot")).join(names, "src_no")
    mine = takes.where("times > 0").select("src", "block", "need", "n_there", "pos", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("times") - 1)).alias("pass"), "passes")
    mine = mine.withColumn("slot", F.col("pass") * F.col("n_there") + F.col("pos"))
    s = slots.select(F.col("src").alias("__s"), F.col("slot").alias("__slot"), "shard")
    dealt = mine.join(s, mine["src"].eqNullSafe(s["__s"]) & (mine["slot"] == s["__slot"]))
    dealt = dealt.groupBy("src", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("all_draws"), F.first("passes").alias("whole"), F.max(F.col("need").isNotNull()).alias("ends"))
    c = cut.withColumnsRenamed({"__s": "__cs", "__b": "__cb"})
    dealt = cut_lineage(
        dealt.join(c, dealt["src"].eqNullSafe(c["__cs"]) & (dealt["block"] == c["__cb"]), "left")
        .select(F.col("src").alias("__s"), F.col("block").alias("__b"), "all_draws", "whole", "ends", "cut_h")
    )
    info = sources.select(F.col("src").alias("__name"), F.col("source_size").alias("__ss"), F.col("target").alias("__t"), F.col("n_blocks").alias("__n"))
    full = full.join(info, full["__src"].eqNullSafe(info["__name"])).withColumn("__block", F.pmod(F.shiftright("__h", 8), F.col("__n")))
    full = full.join(dealt, full["__src"].eqNullSafe(dealt["__s"]) & (full["__block"] == dealt["__b"]), "left")
    inside = ~F.col("ends") | (F.col("__h") <= F.coalesce("cut_h", F.lit(-(1 << 63))))
    mine = F.coalesce(F.filter("all_draws", lambda d: (d["pass"] < F.col("whole")) | inside), F.array().cast("array<struct<pass:bigint,shard:int>>"))
    kept = [c for c in keep or docs.columns if c not in ("size", "source_size", "target", "draws")]
    return full.select(*kept, F.col("__size").alias("size"), F.col("__ss").alias("source_size"), F.col("__t").alias("target"), mine.alias("draws"))


def mix(docs: DataFrame, seed: int = 0, **names) -> DataFrame:
    """The mixed rows: the columns of ``docs``, ``shard`` and ``pass``, shuffled inside every shard."""
    drawn = draw(docs, seed=seed, **names)
    rows = drawn.select(*[c for c in docs.columns if c in drawn.columns], F.explode("draws").alias("__d"))
    rows = rows.select(*[c for c in rows.columns if c != "__d"], "__d.shard", "__d.pass")
    key = names.get("key", "doc_id")
    return rows.repartition("shard").sortWithinPartitions("shard", F.xxhash64(F.col(key), "pass", F.lit(seed + 1)))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = draw(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), keep=["doc_id"])
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"))


def mix_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents of the mix, repeated as often as they are taken, in shuffled order."""
    return mix(docs).select(*docs.columns)
