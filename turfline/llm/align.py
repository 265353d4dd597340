"""Alignment of the tokens of two tokenizers over the same text.

Each tokenizer gives cumulative byte ends. Dictionaries from end to token index
are intersected as hash sets; the sorted common ends slice both id lists into
the smallest groups that cover the same bytes, and the links, pairs of tokens
whose bytes overlap, are expanded inside each slice. A blank between two other
characters always starts a token in both, so the text is cut there into words;
a word's groups and links do not depend on its neighbours, and a bounded table
in each task keeps those of words seen before. Tokenizers without that property
align the text in one piece.

A link's weight is how often its pair of ids is linked in the whole corpus.
Pairs are counted by a partial aggregate. Those with at least one in
``HOT_SHARE`` of all links, at most ``HOT_SHARE`` pairs by definition, go to
every task; the links of all other pairs, none of which holds more than that
share, are joined by pair.

A text that is null, empty, or that one of the tokenizers does not give back
byte by byte (after the leading blank), has no tokens: zeros and an empty
digest. Texts of any length are aligned whole. Every row has a result, repeated
rows each their own, and the links of each count; an empty table has an empty
result. Columns with the name of a result are replaced.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate, chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turfline.functions.lineage import cut_lineage
from turfline.llm.common import table
from turfline.llm.pieces import separable

BYTE_LEVEL = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
MARK = "▁"
#: Most pairs that are sent to every task, 16 bytes each; a pair must have this part of all links.
HOT_SHARE = 200_000
#: Bytes of text that a task turns into tokens at a time (one longer text is a turn of its own).
TURN_BYTES = 300_000
#: Words that a task keeps in each of two generations, and characters of the longest one kept; both bound its memory
#: and leave results alone.
KEPT_WORDS = 80_000
KEPT_LENGTH = 48
_WORDS = re.compile(r"(?<=\S)(?= \S)").split

_DOCUMENT = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
_PAIRS = "pair_a array<int>, pair_b array<int>, pair_n array<int>"


def _file(model: str) -> str:
    import public_tokenizers

    return model if "/" in model else public_tokenizers.path(model)


def byte_of_symbol() -> dict[str, int]:
    """Bytes behind the symbols of byte-level vocabularies: printable Latin-1 stands for itself, others follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokens:
    """A tokenizer as a function from texts that start with a blank to id lists, and the bytes of each id.

    ``by_word`` tells that a blank between other characters always starts a token.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], entries: list[bytes], by_word: bool):
        self.encode, self.entries, self.by_word = encode, entries, by_word
        self.lengths = [len(e) for e in entries]


def byte_level(model: str = BYTE_LEVEL) -> Tokens:
    """Byte-level ids; strings of special tokens are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark spreads the work
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(_file(model))
    tokenizer.encode_special_tokens = True
    byte = byte_of_symbol()
    entries = [b""] * tokenizer.get_vocab_size()
    for token, i in tokenizer.get_vocab().items():
        entries[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    settings = json.loads(tokenizer.to_str())
    split = settings["pre_tokenizer"] or {}
    by_word = settings["normalizer"] is None and split.get("type") == "ByteLevel" and bool(split.get("use_regex", True)) and not split.get("add_prefix_space")

    def encode(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    return Tokens(encode, entries, by_word)


def pieces(model: str = PIECES) -> Tokens:
    """Ids of SentencePiece; the library itself puts the first blank before a text."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=_file(model))

    def entry(i: int) -> bytes:
        piece = processor.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if processor.is_byte(i) else piece.replace(MARK, " ").encode()

    def encode(texts: list[str]) -> list[list[int]]:
        return processor.encode([t[1:] for t in texts], num_threads=1)

    return Tokens(encode, [entry(i) for i in range(processor.vocab_size())], separable(processor))


def cuts(a_ends: Sequence[int], b_ends: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """The ends that both lists have, in order, and the number of tokens of each list up to them."""
    a_at, b_at = dict(zip(a_ends, count(1))), dict(zip(b_ends, count(1)))
    common = sorted(a_at.keys() & b_at.keys())
    return common, [a_at[e] for e in common], [b_at[e] for e in common]


class Labels:
    """Texts of the ids of both tokenizers with what follows them: ``,`` inside a group, ``|`` and ``;`` at its ends."""

    def __init__(self, n_a: int, n_b: int):
        self.n_a, self.n_b = n_a, n_b
        self.texts = [f"{i}{after}" for n, ends in ((n_a, ",|"), (n_b, ",;")) for after in ends for i in range(n)]
        self.lengths = np.array([len(t) for t in self.texts])


@dataclass
class Alignment:
    """Per group: its end, tokens of both lists, links and characters of ``text`` up to there."""

    ends: np.ndarray
    a_upto: np.ndarray
    b_upto: np.ndarray
    links_upto: np.ndarray
    chars_upto: np.ndarray
    text: str  # ``a1,a2|b1;a3|b2;``
    links: np.ndarray  # linked ids as ``a * 2**32 + b``


def align_ids(a_ids: Sequence[int], b_ids: Sequence[int], a_ends: Sequence[int], b_ends: Sequence[int], labels: Labels) -> Alignment:
    """Groups between common ends and the links inside them.

    Two tokens overlap in one stretch, and it ends where one of them ends. So
    every end of either list is one link: of the tokens that cover it.
    """
    common, a_upto, b_upto = map(np.array, cuts(a_ends, b_ends))
    a_ids, b_ids, a_ends, b_ends = map(np.array, (a_ids, b_ids, a_ends, b_ends))
    a_group, b_group = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)
    label = np.empty(len(a_ids) + len(b_ids), np.int64)
    # A group's tokens of one list stand before those of the other.
    label[np.arange(len(a_ids)) + np.concatenate([[0], b_upto])[a_group]] = a_ids + labels.n_a * (common[a_group] == a_ends)
    label[np.arange(len(b_ids)) + a_upto[b_group]] = 2 * labels.n_a + b_ids + labels.n_b * (common[b_group] == b_ends)
    texts = labels.texts
    text = "".join([texts[i] for i in label.tolist()])
    ends = np.sort(np.concatenate([a_ends, b_ends]), kind="stable")
    ends = ends[np.diff(ends, prepend=0) > 0]
    links = (a_ids[np.searchsorted(a_ends, ends)] << 32) | b_ids[np.searchsorted(b_ends, ends)]
    chars = np.cumsum(labels.lengths[label])[a_upto + b_upto - 1]
    return Alignment(common, a_upto, b_upto, np.searchsorted(ends, common) + 1, chars, text, links)


def _turns(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``TURN_BYTES`` of text."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > TURN_BYTES:
            yield start, i
            start, held = i, 0
        held += int(size)
    if len(sizes) > start:
        yield start, len(sizes)


def align(
    df: DataFrame,
    text: str = "text",
    a: Callable[[], Tokens] = byte_level,
    b: Callable[[], Tokens] = pieces,
    keep_groups: bool = False,
) -> DataFrame:
    """``df`` with token counts, digest of the groups, and the distinct linked pairs of each text with their number.

    ``keep_groups`` adds the groups themselves as an array of texts.
    """
    fields = f"{_DOCUMENT}, {_PAIRS}" + (", alignment array<string>" if keep_groups else "")
    added = T._parse_datatype_string(fields)
    taken = {f.name.lower() for f in added}
    passed = [c for c in df.columns if c.lower() not in taken]
    staged = df.select(*[F.col(f"`{c}`") for c in passed], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([*staged.schema.fields[:-1], *added.fields])
    numbers, counted = pa.int32(), [f.name for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(a(), b())
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for start, end in _turns(texts):
                found = words.align([t or "" for t in texts.slice(start, end - start).to_pylist()])
                pairs, times = (np.concatenate([f[i] for f in found]) for i in (5, 6))
                offsets = pa.array(np.cumsum([0, *[len(f[5]) for f in found]]).astype(np.int32))
                lists = [pa.array(v.astype(np.int32), type=numbers) for v in (pairs >> 32, pairs & 0xFFFFFFFF, times)]
                new = [pa.array([f[i] for f in found], pa.int64()) for i in range(4)]
                new.append(pa.array([hashlib.sha256(f[4].encode()).hexdigest() if f[4] else "" for f in found]))
                new += [pa.ListArray.from_arrays(offsets, v) for v in lists]
                if keep_groups:
                    new.append(pa.array([f[4].split(";") if f[4] else [] for f in found], pa.list_(pa.string())))
                kept = batch.slice(start, end - start).columns[:-1]
                yield pa.RecordBatch.from_arrays([*kept, *new], names=[*passed, *counted])

    return staged.mapInArrow(run, schema)


class Words:
    """Aligns texts word by word; a word gives its numbers of tokens and groups, its groups as text and its links as bytes.

    Words seen before are kept in two generations: when the younger one is
    full, the older one is dropped, so words in use stay.
    """

    def __init__(self, a: Tokens, b: Tokens):
        self.a, self.b = a, b
        self.by_word = a.by_word and b.by_word
        self.labels = Labels(len(a.entries), len(b.entries))
        self.young: dict[str, tuple | None] = {}
        self.old: dict[str, tuple | None] = {}

    def _aligned(self, texts: list[str]) -> Iterator[Alignment | None]:
        """None for a text that is not given back byte by byte."""
        a, b = self.a, self.b
        for text, a_ids, b_ids in zip(texts, a.encode(texts), b.encode(texts)):
            raw = text.encode()
            if b"".join([a.entries[i] for i in a_ids]) == raw == b"".join([b.entries[i] for i in b_ids]):
                ends = list(accumulate([a.lengths[i] for i in a_ids])), list(accumulate([b.lengths[i] for i in b_ids]))
                yield align_ids(a_ids, b_ids, *ends, self.labels)
            else:
                yield None

    def _alone(self, words: list[str]) -> dict[str, tuple | None]:
        found = {}
        for word, w in zip(words, self._aligned(words)):
            found[word] = w and (int(w.a_upto[-1]), int(w.b_upto[-1]), len(w.ends), w.text[:-1], w.links.tobytes())
        return found

    def _together(self, words: list[str]) -> dict[str, tuple | None]:
        """Words that a blank starts and another character ends, encoded as one text and cut at their own ends."""
        text = "".join(words)
        whole = next(self._aligned([text]))
        if whole is None:
            return self._alone(words)
        ends = np.cumsum(list(map(len, words)))
        if not text.isascii():  # characters to bytes: all bytes but the following ones of a character start one
            raw = np.frombuffer(text.encode(), np.uint8)
            ends = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))[ends]
        at = np.searchsorted(whole.ends, ends)
        if (whole.ends[at] != ends).any():
            return self._alone(words)
        upto = whole.a_upto[at], whole.b_upto[at], at + 1, whole.chars_upto[at], whole.links_upto[at]
        numbers = [np.diff(u, prepend=0).tolist() for u in upto[:3]]
        (c0, c1), (l0, l1) = [([0, *u.tolist()], u.tolist()) for u in upto[3:]]
        groups, links = whole.text, whole.links.tobytes()
        return {w: (a, b, g, groups[c : d - 1], links[8 * i : 8 * j]) for w, a, b, g, c, d, i, j in zip(words, *numbers, c0, c1, l0, l1)}

    def _known(self, words: set[str]) -> dict[str, tuple | None]:
        young, old = self.young, self.old
        known = {w: young[w] for w in words & young.keys()}
        again = {w: old[w] for w in words & old.keys() if w not in known}
        missing = [w for w in words if w not in known and w not in again]
        fresh: dict[str, tuple | None] = {}
        if self.by_word:
            odd = [w for w in missing if MARK in w or w[-1].isspace()]
            if odd:
                fresh |= self._alone(odd)
                missing = [w for w in missing if w not in fresh]
            if missing:
                fresh |= self._together(missing)
        elif missing:
            fresh = self._alone(missing)
        young |= again
        young |= fresh if max(map(len, fresh), default=0) <= KEPT_LENGTH else {w: r for w, r in fresh.items() if len(w) <= KEPT_LENGTH}
        if len(young) > KEPT_WORDS:
            self.old, self.young = young, {}
        known |= again
        known |= fresh
        return known

    def align(self, texts: list[str]) -> list[tuple]:
        """Numbers of tokens, groups and links, groups as text, linked pairs and how often each is linked, of every text."""
        cut = [(_WORDS(" " + t) if self.by_word else [" " + t]) if t else [] for t in texts]
        known = self._known(set(chain.from_iterable(cut)))
        out, nothing = [], np.zeros(0, np.int64)
        for words in cut:
            rows = [known[w] for w in words]
            if not rows or None in rows:
                out.append((0, 0, 0, 0, "", nothing, nothing))
                continue
            n_a, n_b, n_groups, groups, links = zip(*rows)
            pairs, times = np.unique(np.frombuffer(b"".join(links), np.int64), return_counts=True)
            out.append((sum(n_a), sum(n_b), sum(n_groups), int(times.sum()), ";".join(groups), pairs, times))
        return out


def _packed(a, b):
    """A pair of ids as one number."""
    return a.cast("bigint") * (1 << 32) + b


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Links of every pair of ids in the corpus, and whether no other pair of its ``b`` id has more."""
    each = aligned.select(F.explode(F.arrays_zip("pair_a", "pair_b", "pair_n")).alias("p"))
    counts = cut_lineage(each.groupBy(_packed(F.col("p.pair_a"), F.col("p.pair_b")).alias("pair")).agg(F.sum(F.col("p.pair_n").cast("bigint")).alias("links")))
    b = F.col("pair") % (1 << 32)
    best = counts.groupBy(b.alias("_b")).agg(F.max("links").alias("_most"))  # a row per id of the vocabulary at most
    return counts.join(F.broadcast(best), b == F.col("_b")).select("pair", "links", (F.col("links") == F.col("_most")).alias("best"))


def weigh(aligned: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """``key, n_best, count_sum`` of every row: links with the most frequent partner of their ``b`` id, sum of the counts.

    ``aligned`` and ``counts`` are read several times: pass written tables.
    """
    total = counts.agg(F.sum("links")).first()[0] or 0
    is_hot = F.col("links") * HOT_SHARE >= F.lit(total)
    hot = counts.where(is_hot).toPandas().sort_values("pair")  # at most HOT_SHARE rows
    shared = aligned.sparkSession.sparkContext.broadcast(
        (hot["pair"].to_numpy(np.int64), hot["links"].to_numpy(np.int64), hot["best"].to_numpy(bool))
    )
    fields = "key bigint, n_best bigint, count_sum bigint, cold array<bigint>, cold_n array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, links, best = shared.value
        for batch in batches:
            lists = batch.column(1), batch.column(2), batch.column(3)
            a, b, n = [c.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in lists]
            sizes = np.asarray(pc.list_value_length(lists[0]), np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            pair = a * (1 << 32) + b
            at = np.minimum(np.searchsorted(pairs, pair), max(len(pairs) - 1, 0))
            known = pairs[at] == pair if len(pairs) else np.zeros(len(pair), bool)
            weight, top = np.zeros(len(pair), np.int64), np.zeros(len(pair), np.int64)
            weight[known] = n[known] * links[at[known]]
            top[known] = n[known] * best[at[known]]
            sums = [np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)]
            np.add.at(sums[0], row, top)
            np.add.at(sums[1], row, weight)
            left = np.concatenate([[0], np.cumsum(np.bincount(row[~known], minlength=len(sizes)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(sums[0]), pa.array(sums[1]),
                    pa.ListArray.from_arrays(pa.array(left), pa.array(pair[~known])),
                    pa.ListArray.from_arrays(pa.array(left), pa.array(n[~known].astype(np.int32))),
                ],
                names=["key", "n_best", "count_sum", "cold", "cold_n"],
            )

    parts = cut_lineage(aligned.select(F.col(key).alias("key"), "pair_a", "pair_b", "pair_n").mapInArrow(run, fields))
    rest = parts.select("key", F.explode(F.arrays_zip("cold", "cold_n")).alias("p")).select("key", F.col("p.cold").alias("pair"), F.col("p.cold_n").alias("n"))
    weighed = rest.join(counts.where(~is_hot), "pair")
    sums = weighed.select("key", F.when(F.col("best"), F.col("n")).otherwise(0).cast("bigint").alias("n_best"), (F.col("n") * F.col("links")).alias("count_sum"))
    both = parts.select("key", "n_best", "count_sum").unionByName(sums)
    return both.groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def link_counts(df: DataFrame, text: str = "text", keep_groups: bool = False) -> DataFrame:
    """``df`` with its alignment, the links to the most frequent partner and the sum of their counts in the corpus."""
    aligned = cut_lineage(align(df.withColumn("__key", F.monotonically_increasing_id()), text, keep_groups=keep_groups))
    found = weigh(aligned, cut_lineage(pair_counts(aligned)), "__key").withColumnRenamed("key", "__key")
    kept = [c for c in aligned.columns if c.lower() not in ("n_best", "count_sum")]
    return aligned.select(*[F.col(f"`{c}`") for c in kept]).join(found, "__key").drop("__key")


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts, groups, links and corpus-wide link counts of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    aligned = cut_lineage(align(docs.withColumn("__key", F.monotonically_increasing_id())).drop("text"))
    found = weigh(aligned, cut_lineage(pair_counts(aligned)), "__key")
    cols = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return aligned.drop("pair_a", "pair_b", "pair_n").join(found, aligned["__key"] == found["key"]).select("doc_id", *cols)
