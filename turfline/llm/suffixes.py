"""Repeated passages by sorted suffixes: sampled splitters, local multikey quicksort, comparison of neighbours.

Sorting every suffix of a corpus would move each byte hundreds of times. The
suffixes that are sorted here start at anchors, which the text itself chooses:
of every window of WINDOW bytes the gram of GRAM bytes with the least hash, so
equal windows have equal grams at equal places. Grams that occur once end the
search for their windows, and so do spans (all windows of one anchor) that are
repeated whole. The suffixes of the rest are range-partitioned by their leading
bytes, sorted, and compared with their neighbours. A gram with many spans is
split: the windows of its spans that start close together share more than the
gram, so their suffixes are told apart by more leading bytes (``split_hot``).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turfline.functions.lineage import cut_lineage
from turfline.llm import rolling
from turfline.llm.common import flat_rows, table, with_columns

#: Bytes of a repeat, and of the gram that anchors it.
WINDOW, GRAM = 400, 160
#: Gram starts in a window, the most windows of an anchor.
STARTS = WINDOW - GRAM + 1
#: Suffixes that one task sorts, on average.
BUCKET = 4096
#: Spans with equal leading bytes that one task sorts; more of them are split on further bytes.
HOT = 2000
#: A key with this many rows, and with more than one row in MOST_HOT of its table, is joined on the map
#: side; there are at most MOST_HOT such keys in any table, which bounds what is broadcast.
HOT_ROWS, MOST_HOT = 20_000, 50_000
#: Window starts whose anchors are found at a time, and bits for a position among them.
PART, BITS = 1 << 22, 23


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Position, first and last window start, gram hash and span hash of every anchor of a text."""
    found = []
    for base in range(0, len(data) - WINDOW + 1, PART):
        part = data[base : base + PART + WINDOW - 1]
        running = rolling.prefix(part)
        at = np.arange(len(part) - GRAM + 1)
        h = rolling.between(running, at, at + GRAM)
        # Least hash, then leftmost: the position stands in the low bits.
        least = (h >> np.uint64(BITS) << np.uint64(BITS)) | at.astype(np.uint64)
        width = 1
        while width * 2 <= STARTS:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < STARTS:
            least = np.minimum(least[: len(least) - (STARTS - width)], least[STARTS - width :])
        of = (least & np.uint64((1 << BITS) - 1)).astype(np.int64)
        change = np.flatnonzero(of[1:] != of[:-1]) + 1
        lo, hi = np.concatenate(([0], change)), np.concatenate((change - 1, [len(of) - 1]))
        pos = of[lo]
        found.append((pos + base, lo + base, hi + base, h[pos].view(np.int64), rolling.between(running, lo, hi + WINDOW).view(np.int64)))
    if not found:
        return (np.zeros(0, np.int64),) * 5
    return tuple(np.concatenate(c) for c in zip(*found))


def multikey_order(words: np.ndarray) -> np.ndarray:
    """Order of rows of unsigned words by multikey quicksort: split by one word, go on with the next where equal."""
    order = np.arange(len(words))
    todo = [(0, len(words), 0)]
    while todo:
        a, b, depth = todo.pop()
        if b - a < 2 or depth == words.shape[1]:
            continue
        rows = order[a:b]
        if b - a <= 24:
            order[a:b] = rows[np.lexsort(words[rows, depth:].T[::-1])]
            continue
        key = words[rows, depth]
        pivot = np.sort(key[[0, len(key) // 2, -1]])[1]
        less, same = key < pivot, key == pivot
        more = ~(less | same)
        order[a:b] = np.concatenate((rows[less], rows[same], rows[more]))
        m1, m2 = a + int(less.sum()), b - int(more.sum())
        todo += [(a, m1, depth), (m1, m2, depth + 1), (m2, b, depth)]
    return order


def sorted_prefixes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte rows, and the common prefix of each with the one before it (-1 for the first)."""
    words = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    order = multikey_order(words)
    placed = rows[order]
    differ = placed[1:] != placed[:-1]
    common = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return order, np.concatenate(([-1], common))


def repeated_windows(contexts: list[bytes], offsets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Which windows of each context (a span around an anchor at ``offsets``) occur twice or more.

    Two windows are equal if they have the anchor at the same place, equal bytes
    from there on and equal bytes before it. The suffixes from the anchors and
    the reversed texts before them are sorted once; for each place of the
    anchor, rows whose neighbours agree far enough form classes.
    """
    m, left_width = len(contexts), -(-(STARTS - 1) // 8) * 8
    right, left = np.zeros((m, WINDOW), np.uint8), np.zeros((m, left_width), np.uint8)
    n_windows = np.array([len(c) - WINDOW + 1 for c in contexts])
    for i, (c, off) in enumerate(zip(contexts, offsets)):
        row = np.frombuffer(c, np.uint8)
        tail = row[off : off + WINDOW]
        right[i, : len(tail)] = tail
        left[i, :off] = row[:off][::-1]
    right_order, right_common = sorted_prefixes(right)
    left_order, left_common = sorted_prefixes(left)
    out = np.zeros((m, STARTS), bool)
    right_class, left_class = np.empty(m, np.int64), np.empty(m, np.int64)
    for before in range(STARTS):
        rows = np.flatnonzero((before <= offsets) & (before > offsets - n_windows))
        if len(rows) == 0:
            continue
        right_class[right_order] = np.cumsum(right_common < WINDOW - before)
        left_class[left_order] = np.cumsum(left_common < before)
        _, inverse = np.unique(right_class[rows] * (m + 1) + left_class[rows], return_inverse=True)
        total = np.bincount(inverse, counts[rows])
        out[rows, offsets[rows] - before] = total[inverse] >= 2
    return out


def _sorted_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Byte intervals of the repeated windows among the suffixes of one range partition."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    tid, lo, offset, n, context = (pa.concat_arrays([b.column(i) for b in held]) for i in range(5))
    contexts = context.to_pylist()
    flags = repeated_windows(contexts, np.asarray(offset), np.asarray(n))
    edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, start = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    first = np.asarray(lo)[row]
    yield pa.RecordBatch.from_arrays([tid.take(pa.array(row)), pa.array(first + start), pa.array(first + end - 1 + WINDOW)], names=["tid", "a", "b"])


def _listed():
    def of(tids, texts):
        keys, out = [], [[] for _ in range(5)]
        for tid, t in zip(tids, texts):
            found = anchors(np.frombuffer((t or "").encode(), np.uint8))
            keys += [tid] * len(found[0])
            for o, v in zip(out, found):
                o.append(v)
        return [keys, *[np.concatenate(o) if o else np.zeros(0, np.int64) for o in out]]

    return of


def _contexts():
    def of(tids, texts, wanted):
        out = [[] for _ in range(6)]
        for tid, t, spans in zip(tids, texts, wanted):
            data = t.encode()
            for s in spans:
                for o, v in zip(out, (tid, s["lo"], s["pos"] - s["lo"], s["n"], data[s["lo"] : s["hi"] + WINDOW], s["hot"])):
                    o.append(v)
        return out

    return of


def met(rows: DataFrame, counted: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of ``rows`` to a written table of their keys and numbers of rows, ``_rows``; a key may hold any share.

    Rows of the few keys with very many rows stay where they are, see MOST_HOT; the others are shuffled.
    """
    limit = max(HOT_ROWS, rows.count() // MOST_HOT)
    hot = F.broadcast(counted.where(F.col("_rows") > limit))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(counted.where(F.col("_rows") <= limit), keys)
    return rows.join(hot, keys).unionByName(rest).drop("_rows")


def core() -> Column:
    """The bytes that all windows of a row's range share: they have ``low`` to ``high`` bytes before the anchor."""
    return F.substring(F.col("context"), F.col("off") - F.col("low") + 1, WINDOW - F.col("high") + F.col("low"))


def split_hot(spans: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Spans of grams with many spans as rows that can be sorted, and the intervals that were found on the way.

    The windows of a span are halved by the place of the anchor in them. The
    windows of a half share ``core``, which is longer than that of the whole:
    rows with different cores have no window in common. Rows that agree in all
    their windows are repeats, and one goes on for all of them. A core with HOT
    rows at most is sorted in one task; the rows of others are halved again.
    A half of one window is its core, so nothing is left after eight levels,
    and a row goes on in those halves only whose core many rows share.
    """
    ready, found, rows = [], [], spans
    while rows.count():
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        halves = F.explode(F.array(F.struct("low", middle.alias("high")), F.struct((middle + 1).alias("low"), "high")))
        cut = rows.withColumn("half", halves).select("tid", "lo", "off", "n", "context", "half.*")
        # The places of the anchor in the windows that the row has of this half.
        first = F.greatest("low", F.col("off") - F.length("context") + WINDOW)
        last = F.least("high", "off")
        cut = cut.withColumns({"first": first, "last": last}).where("first <= last")
        part = F.substring(F.col("context"), F.col("off") - F.col("last") + 1, WINDOW + F.col("last") - F.col("first"))
        cut = cut.select("tid", (F.col("lo") + F.col("off") - F.col("last")).alias("lo"), F.col("last").alias("off"), "n", part.alias("context"), "low", "high")
        held = cut_lineage(cut.withColumns({"core": F.unhex(F.md5(core())), "hull": F.unhex(F.md5("context"))}))
        same = ["low", "high", "core", "hull", "off"]
        ones = held.groupBy(*same).agg(F.count(F.lit(1)).alias("_rows"), F.sum("n").alias("n"), F.min(F.struct("tid", "lo", "context")).alias("one"))
        ones = cut_lineage(ones.withColumn("n", F.least("n", F.lit(2)).cast("int")))
        twins = ones.where("_rows > 1").select(*same, "_rows")
        found.append(met(held, twins, same).select("tid", F.col("lo").alias("a"), (F.col("lo") + F.length("context")).alias("b")))
        kinds = cut_lineage(ones.groupBy("low", "core").agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").withColumn("kinds", F.col("_rows")))
        open_ = met(ones.select("low", "high", "core", "off", "n", "one"), kinds, ["low", "core"])
        open_ = cut_lineage(open_.select("one.tid", "one.lo", "off", "n", "one.context", "low", "high", "kinds"))
        ready.append(open_.where(F.col("kinds") <= HOT).drop("kinds"))
        rows = open_.where(F.col("kinds") > HOT).drop("kinds")
    return ready, found


def repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Byte intervals ``a`` to ``b`` of the texts ``tid`` (their MD5) that strings of WINDOW bytes with a twin cover.

    Nothing is gathered for a text, a gram or a passage as a whole: grams and
    spans are counted with a combine before the shuffle, of equal spans one
    stands for all, and keys with very many rows are joined where they are.
    Suffixes with equal leading bytes (the gram, or the longer core of a split
    gram) fall into one range partition, so neighbours across a boundary share
    no window and need no comparison.
    """
    slim = docs.select(text_key(F.col(text)).alias("tid"), F.col(text).alias("t")).where(F.octet_length(F.col(text)) >= WINDOW)
    rows = cut_lineage(flat_rows(slim, ["tid", "t"], _listed, "tid binary, pos long, lo long, hi long, gram long, span long"))
    again = cut_lineage(rows.groupBy("gram").agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1"))
    kept = cut_lineage(met(rows, again, ["gram"]))
    spans = kept.groupBy("gram", "span").agg(F.count(F.lit(1)).alias("_rows"), F.min(F.struct("tid", "pos", "lo", "hi")).alias("one"))
    spans = cut_lineage(spans)
    twins = spans.where("_rows > 1").select("gram", "span", "_rows")
    whole = met(kept, twins, ["gram", "span"]).select("tid", F.col("lo").alias("a"), (F.col("hi") + WINDOW).alias("b")).distinct()
    kinds = cut_lineage(spans.groupBy("gram").agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").withColumn("kinds", F.col("_rows")))
    mixed = met(spans.select("gram", "one", F.least("_rows", F.lit(2)).cast("int").alias("n")), kinds, ["gram"])
    mixed = mixed.select("one.*", "n", (F.col("kinds") > HOT).alias("hot"))
    per_text = mixed.groupBy("tid").agg(F.collect_list(F.struct("pos", "lo", "hi", "n", "hot")).alias("wanted"))
    # Of the copies of a text one is read.
    texts = slim.groupBy("tid").agg(F.first("t").alias("t"))
    found = flat_rows(texts.join(per_text, "tid"), ["tid", "t", "wanted"], _contexts, "tid binary, lo long, off int, n int, context binary, hot boolean")
    found = cut_lineage(found.withColumns({"low": F.lit(0), "high": F.lit(STARTS - 1)}))
    ready, on_the_way = split_hot(found.where("hot").drop("hot"))
    cold = reduce(DataFrame.unionByName, ready, found.where("not hot").drop("hot"))
    buckets = max(1, -(-cold.count() // BUCKET))
    # Leading bytes in order, then a hash of all that are shared: splitters stay short.
    ranged = cold.withColumns({"lead": F.substring(core(), 1, 16), "shared": F.xxhash64(core())}).repartitionByRange(buckets, "lead", "shared")
    by_sort = ranged.select("tid", "lo", "off", "n", "context").mapInArrow(_sorted_bucket, "tid binary, a long, b long")
    return reduce(DataFrame.unionByName, on_the_way, whole.unionByName(by_sort))


def text_key(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.md5(text.cast("binary")))


def remove_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``removed``, the byte spans that repeat, and ``kept``, the other bytes of the UTF-8 text.

    A byte goes if a string of WINDOW bytes that covers it also starts anywhere
    else, in this text or another; strings never cross texts and are judged on
    the input. Null and short texts keep all their bytes. Repeated rows are
    repeats of each other. ``kept`` is binary, as a cut may split a character.
    """
    rows = [c for c in docs.columns if c not in ("removed", "kept")]
    found = repeats(docs, text).groupBy("tid").agg(F.collect_set(F.struct("a", "b")).alias("__found"))
    keyed = docs.select(*rows, text_key(F.col(text)).alias("__tid"))
    marked = keyed.join(found, keyed["__tid"] == found["tid"], "left").select(*rows, "__found")

    def make():
        def one(t, found):
            data = (t or "").encode()
            merged: list[list[int]] = []
            for a, b in sorted((s["a"], s["b"]) for s in found or ()):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            kept, end = [], 0
            for a, b in merged:
                kept.append(data[end:a])
                end = b
            return [{"start": a, "end": b} for a, b in merged], b"".join([*kept, data[end:]])

        def of(texts, found):
            done = [one(t, f) for t, f in zip(texts, found)]
            return [d[0] for d in done], [d[1] for d in done]

        return of

    out = with_columns(marked, [text, "__found"], make, "removed array<struct<start: long, end: long>>, kept binary")
    return out.select(*rows, "removed", "kept")


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.aggregate("removed", F.lit(0).cast("long"), lambda s, r: s + r["end"] - r["start"]).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
