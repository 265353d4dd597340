"""Personal data: patterns, and a semi-Markov conditional random field over whole candidate spans."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turfline.functions.lineage import cut_lineage
from turfline.llm.common import flat_rows, table, with_columns
from turfline.llm.sample import by_hash
from turfline.llm.spans import SPANS, as_rows, joined, of_kind

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match starts where its digits do, so a long run of digits is read once.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A word with a digit or an at sign: what an entity can be made of.
_CHUNK = re.compile(r"(?<!\S)[^\s0-9@]*[0-9@]\S*")
_LEAD = re.compile(r"[^A-Za-z0-9+(]*")
#: Most words of an entity.
LONGEST = 5
#: Hashed features.
BUCKETS = 1 << 14
LABELS = ("", *KINDS)
#: Most word sequences the weights are fitted on (the documented bound of the sample), and their greatest length.
SAMPLE_SEQUENCES, SAMPLE_WORDS = 1500, 40


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str):
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[str, int, int, float]]:
    """Leftmost non-overlapping matches per kind, by kind as listed, then start; failing matches are dropped."""
    out = [("email", a, b, 1.0) for a, b in _emails(text)]
    out += [("ip", *m.span(), 1.0) for m in _IP.finditer(text) if all(_small(p) for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span(), 1.0))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span(), 1.0))
    return out


def _small(part: str) -> bool:
    tail = part.lstrip("0")
    return len(tail) <= 3 and int(tail or 0) <= 255


def sequences(text: str) -> list[list[tuple[int, int]]]:
    """Runs of chunks with only a few blanks between them."""
    out: list[list[tuple[int, int]]] = []
    for m in _CHUNK.finditer(text):
        a, b = m.span()
        if out and a - out[-1][-1][1] <= 2 and "\n" not in text[out[-1][-1][1] : a]:
            out[-1].append((a, b))
        else:
            out.append([(a, b)])
    return out


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    a = _LEAD.match(text, a, b).end()
    while b > a and not (text[b - 1].isascii() and text[b - 1].isalnum()):
        b -= 1
    return a, b


_SHAPE = (re.compile("[0-9]+"), re.compile(r"[^\W\d_]+"))


def features(text: str, a: int, b: int, words: int, before: str) -> list[int]:
    """Hashed features of a whole span: shape, digits, checks, parts, and the word before it."""
    s = text[a:b]
    digits = "".join(c for c in s if "0" <= c <= "9")
    shape = _SHAPE[1].sub("a", _SHAPE[0].sub("9", s))
    parts = s.split(".")
    named = [
        "one", f"words {words}", f"shape {shape[:40]}", f"digits {min(len(digits), 20)}", f"signs {''.join(sorted(set(shape) - set('9a')))}",
        f"groups {'-'.join(str(len(g)) for g in re.findall('[0-9]+', s)[:6])}", f"before {before}",
        f"sum {13 <= len(digits) <= 19 and luhn(digits)} {shape.startswith('9')}",
        f"address {len(parts) == 4 and all('0' <= p[:1] <= '9' and p.isdigit() and _small(p) for p in parts)}",
        f"at {s.count('@')} {'.' in s.partition('@')[2]}", f"plus {s.startswith('+')} {9 <= len(digits) <= 15}",
    ]
    return [zlib.crc32(f.encode()) % BUCKETS for f in named]


def _segments(text: str, run: list[tuple[int, int]]) -> list[dict]:
    """All candidate spans of a run: ``[end][length] -> (span, features)``, of LONGEST words at most."""
    out = []
    for j in range(len(run)):
        ending = {}
        for n in range(1, min(LONGEST, j + 1) + 1):
            first = run[j - n + 1][0]
            a, b = _trimmed(text, first, run[j][1])
            if b > a:
                before = re.search(r"(\w+)\W*\Z", text[max(0, first - 24) : first])
                ending[n] = ((a, b), features(text, a, b, n, before[1].lower() if before and before[1].isalpha() else ""))
            else:
                ending[n] = ((a, a), [0])
        out.append(ending)
    return out


@dataclass
class SpanModel:
    """Semi-Markov weights: per feature and label, and per pair of labels in a row."""

    weights: np.ndarray
    moves: np.ndarray

    def scores(self, segments: list[dict]) -> list[dict]:
        """Per end and length the scores of the labels; only one word at a time can be outside."""
        out = []
        for ending in segments:
            here = {}
            for n, (_, at) in ending.items():
                s = self.weights[at].sum(0)
                if n > 1:
                    s = s.copy()
                    s[0] = -np.inf
                here[n] = s
            out.append(here)
        return out

    def decode(self, segments: list[dict]) -> list[tuple[int, int, int, float]]:
        """The best segmentation's entities: label, last word, words, and the gain over being outside."""
        scores = self.scores(segments)
        best = [np.concatenate(([0.0], np.full(len(LABELS) - 1, -np.inf)))]
        back: list[list] = [[]]
        for j, here in enumerate(scores):
            value = np.full(len(LABELS), -np.inf)
            link: list = [None] * len(LABELS)
            for n, s in here.items():
                through = best[j + 1 - n][:, None] + self.moves
                frm = through.argmax(0)
                got = through[frm, np.arange(len(LABELS))] + s
                for k in np.flatnonzero(got > value):
                    value[k], link[k] = got[k], (n, int(frm[k]))
            best.append(value)
            back.append(link)
        out, j, k = [], len(segments), int(best[-1].argmax())
        while j > 0:
            n, frm = back[j][k]
            if k:
                alone = sum(scores[i][1][0] for i in range(j - n, j))
                out.append((k, j - 1, n, float(scores[j - 1][n][k] - alone)))
            j, k = j - n, frm
        return out[::-1]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    m = np.where(np.isfinite(m), m, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - m).sum(axis)) + m.squeeze(axis)


def fit_weights(data: list[tuple[list[dict], list[tuple[int, int, int]]]], epochs: int = 4, rate: float = 0.15, decay: float = 1e-4) -> SpanModel:
    """Stochastic gradient steps on the likelihood of the gold segmentations (label, last word, words)."""
    k = len(LABELS)
    model = SpanModel(np.zeros((BUCKETS, k)), np.zeros((k, k)))
    rng = np.random.default_rng(11)
    for _ in range(epochs):
        for d in rng.permutation(len(data)):
            segments, gold = data[d]
            scores = model.scores(segments)
            n_words = len(segments)
            ahead = [np.concatenate(([0.0], np.full(k - 1, -np.inf)))]
            for j, here in enumerate(scores):
                ahead.append(_lse(np.stack([_lse(ahead[j + 1 - n][:, None] + model.moves, 0) + s for n, s in here.items()]), 0))
            behind = [np.zeros(k) for _ in range(n_words + 1)]
            for j in range(n_words - 1, -1, -1):
                after = [model.moves + (scores[j + n - 1][n] + behind[j + n])[None] for n in range(1, min(LONGEST, n_words - j) + 1)]
                behind[j] = _lse(np.concatenate(after, 1), 1)
            whole = _lse(ahead[-1], 0)
            moves = np.zeros((k, k))
            steps = []
            for j, here in enumerate(scores):
                for n, s in here.items():
                    joint = np.exp(ahead[j + 1 - n][:, None] + model.moves + s[None] + behind[j + 1][None] - whole)
                    moves -= joint
                    steps.append((segments[j][n][1], -joint.sum(0)))
            last = 0
            for label, j, n in gold:
                moves[last, label] += 1
                one = np.zeros(k)
                one[label] = 1
                steps.append((segments[j][n][1], one))
                last = label
            model.moves += rate * (moves - decay * model.moves)
            for at, g in steps:
                np.add.at(model.weights, at, rate * (g - decay * model.weights[at]))
    return model


def _gold(text: str, run: list[tuple[int, int]], spans: list) -> list[tuple[int, int, int]] | None:
    """The run's segmentation by the base spans; None if a span is longer than an entity can be."""
    out, j = [], 0
    while j < len(run):
        a, b = run[j]
        hit = next((s for s in spans if s[1] < b and s[2] > a), None)
        if hit is None:
            out.append((0, j, 1))
            j += 1
            continue
        n = 1
        while j + n < len(run) and run[j + n][0] < hit[2]:
            n += 1
        if n > LONGEST:
            return None
        out.append((LABELS.index(hit[0]), j + n - 1, n))
        j += n
    return out


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id", sample: int = SAMPLE_SEQUENCES) -> SpanModel:
    """Fit on at most ``sample`` distinct word sequences, chosen by their hash; the base spans of their texts label them.

    Sequences of more than SAMPLE_WORDS words are not learned from. ``key`` no
    longer matters to the sample.
    """

    def listed():
        def of(texts):
            out = ([], [])
            for t in texts:
                runs = [r for r in sequences(t or "") if len(r) <= SAMPLE_WORDS]
                spans = base_spans(t) if runs else []
                for run in runs:
                    a, b = max(0, run[0][0] - 24), run[-1][1]
                    if b - a <= 2000:
                        near = [f"{s[0]}:{s[1] - a}:{s[2] - a}" for s in spans if s[1] < b and s[2] > run[0][0]]
                        for o, x in zip(out, (t[a:b], near)):
                            o.append(x)
            return out

        return of

    rows = docs.select(F.col(text).alias("t")).where(F.col("t").rlike("[0-9@]"))
    found = flat_rows(rows, ["t"], listed, "s string, spans array<string>").distinct()
    picked = by_hash(cut_lineage(found), ["s", "spans"], sample).collect()
    data = []
    for r in picked:
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans)]
        # The sequence is the last one of its excerpt.
        run = (sequences(r.s) or [[]])[-1]
        gold = _gold(r.s, run, spans)
        if run and gold is not None:
            data.append((_segments(r.s, run), gold))
    return fit_weights(data)


def _merged(spans: list) -> list[list[int]]:
    """What the spans cover, as ascending intervals."""
    out: list[list[int]] = []
    for a, b in sorted((a, b) for _, a, b, _ in spans):
        if out and a < out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def find(docs: DataFrame, model: SpanModel, text: str = "text", least: float = 2.0) -> DataFrame:
    """Add ``spans``: the base ones, and apart from them the entities of the best segmentation (kind ``like_<kind>``).

    An added entity has a gain of ``least`` at least over being outside. Whole
    texts are read; a null text counts as empty. Spans are ordered by kind as
    listed, then start; offsets are code points, the end exclusive.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        known = shared.value
        return lambda texts: [[as_rows(scan(t or "", known, least)) for t in texts]]

    return with_columns(docs, [text], make, f"spans {SPANS}")


def scan(t: str, model: SpanModel, least: float = 2.0) -> list[tuple[str, int, int, float]]:
    """The spans of a text, see ``find``."""
    spans = base_spans(t)
    taken = _merged(spans)
    meets = lambda a, b: (i := bisect_right(taken, a, key=lambda s: s[1])) < len(taken) and taken[i][0] < b
    order = {k: i for i, k in enumerate((*KINDS, *(f"like_{k}" for k in KINDS)))}
    for run in sequences(t):
        if all(meets(a, b) for a, b in run):
            continue
        segments = _segments(t, run)
        for label, j, n, gain in model.decode(segments):
            span = segments[j][n][0]
            if gain >= least and not meets(*span):
                spans.append((f"like_{LABELS[label]}", *span, gain))
    return sorted(spans, key=lambda s: (order[s[0]], s[1]))


def redacted(t: str | None, spans: list[tuple[str, int, int, float]]) -> str | None:
    if t is None or not spans:
        return t
    out, at = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda s: s[1]):
        if start >= at:
            out += [t[at:start], f"<{kind.removeprefix('like_')}>"]
        at = max(at, end)
    return "".join([*out, t[at:]])


def redact(docs: DataFrame, model: SpanModel, text: str = "text") -> DataFrame:
    """Replace every found span by its kind in angle brackets; of overlapping spans the first names the whole. Null stays null.

    ``spans`` are added as by ``find``, in the same pass: a task keeps one Python worker.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        known = shared.value

        def of(texts):
            found = [scan(t or "", known) for t in texts]
            return [as_rows(s) for s in found], [redacted(t, s) for t, s in zip(texts, found)]

        return of

    return with_columns(docs, [text], make, f"spans {SPANS}, `{text}` string")


def op8_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = find(docs, fit(docs)).select("doc_id", "spans")
    base = of_kind(F.col("spans"), KINDS)
    counts = [F.size(of_kind(F.col("spans"), [k])).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents without their personal data; ``n_chars`` follows the new text."""
    out = redact(docs, fit(docs)).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
