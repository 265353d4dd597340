"""Secret scans: patterns, and probabilistic automata inferred from the credentials that the patterns label."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turfline.functions.lineage import cut_lineage
from turfline.llm.common import flat_rows, table, with_columns
from turfline.llm.sample import by_hash
from turfline.llm.spans import SPANS, as_rows, joined, of_kind

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{24,}")
#: Least length of a labelled value, and so of what the automata score.
SHORTEST = 6
#: Runs of the characters of credentials; the automata score them whole and in parts.
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % SHORTEST)
_SEPARATOR = re.compile("[=/-]")
#: Most labelled strings of a kind, and most background candidates, that are learned from (the
#: documented bound of the sample), and the longest of them; scoring and thresholds have no such bound.
SAMPLE_STRINGS = 1500
SAMPLE_LENGTH = 400
#: Runs whose scores a task keeps, and the longest of them.
KEPT_RUNS, KEPT_LENGTH = 50_000, 64


def base_spans(text: str) -> list[tuple[str, int, int, float]]:
    """Leftmost matches of every kind; failing ones are dropped."""
    out = []
    if "=" in text or ":" in text:
        out += [("assign", *m.span(), 1.0) for m in _ASSIGN.finditer(text) if len(m[2]) >= SHORTEST]
    if "AKIA" in text:
        out += [("access", *m.span(), 1.0) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span(), 1.0) for m in _HEX.finditer(text)]
    return out


def symbols(s: str) -> str:
    """The classes of the characters: digits, letters up to f and beyond in both cases, signs as they are."""
    return s.translate(_SYMBOLS)


_SYMBOLS = {ord(c): "0" if c.isdigit() else "a" if c in "abcdef" else "g" if c.islower() else "A" if c in "ABCDEF" else "G" for c in
            "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"}
#: Characters of a class; a sign, and the end, is a class of its own.
_SIZE = {"0": 10, "a": 6, "g": 20, "A": 6, "G": 20}
_CLASSES = 12
#: Least probability of a difference by chance, when states are told apart and when a character stands out in its class.
CHANCE = 1e-4


def _choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def _more(x: int, n: int, y: int, m: int) -> bool:
    """Fisher's exact test: whether ``x`` of ``n`` is more than chance beside ``y`` of ``m``; it holds for any counts."""
    both = x + y
    if x * m <= y * n or (x / n - y / m) ** 2 < 4 * (q := both / (n + m)) * (1 - q) * (1 / n + 1 / m):
        return False
    whole = _choose(n + m, both)
    tail = sum(math.exp(_choose(n, k) + _choose(m, both - k) - whole) for k in range(x, min(n, both, x + 60) + 1))
    return tail < CHANCE


def _stands_out(x: int, n: int, size: int) -> bool:
    """Binomial test: whether ``x`` of ``n`` is more than chance for one of ``size`` equally likely characters."""
    if size == 1 or x * size <= n:
        return False
    p, q = math.log(1 / size), math.log(1 - 1 / size)
    return sum(math.exp(_choose(n, k) + k * p + (n - k) * q) for k in range(x, min(n, x + 60) + 1)) < CHANCE


@dataclass
class Automaton:
    """A deterministic probabilistic automaton: per state the counts of what came next ('' is the end) and the next states."""

    counts: list[Counter] = field(default_factory=lambda: [Counter()])
    follow: list[dict] = field(default_factory=lambda: [{}])
    _steps: list[dict] = field(default_factory=list, repr=False)
    #: Characters of all states.
    _wide: Counter = field(default_factory=Counter, repr=False)

    def add(self, s: str) -> None:
        at = 0
        for c in s:
            self.counts[at][c] += 1
            if c not in self.follow[at]:
                self.follow[at][c] = len(self.counts)
                self.counts.append(Counter())
                self.follow.append({})
            at = self.follow[at][c]
        self.counts[at][""] += 1

    def step(self, at: int, c: str) -> tuple[float, int]:
        """Log-probability of a character in a state, and the state after it; computed once."""
        if not self._steps:
            self._steps = [{} for _ in self.counts]
            self._wide = sum(self.counts, Counter())
        got = self._steps[at].get(c)
        if got is None:
            got = self._steps[at][c] = (self._log(at, c), self._after(at, c))
        return got

    def _log(self, at: int, c: str) -> float:
        """Characters that stand out in their class have their own share. The others of the class that any state has
        seen share the rest evenly, less the part that single sightings have; that goes to unseen ones (Good and Turing)."""
        counts, kind = self.counts[at], symbols(c)
        wide = {x: k for x, k in self._wide.items() if symbols(x) == kind}
        size, total = _SIZE.get(kind, 1), sum(counts[x] for x in wide)
        own = {x: counts[x] for x in wide if _stands_out(counts[x], total, size)}
        rest, unseen = total - sum(own.values()), size - len(wide)
        once = rest * sum(k == 1 for k in wide.values()) / sum(wide.values()) + 0.1 if unseen and wide else 0.1
        if c in own:
            share = own[c]
        elif c in wide:
            share = max(rest - once * (unseen > 0), 0.1) / (len(wide) - len(own))
        else:
            share = once / unseen
        return math.log(share / (sum(counts.values()) + 0.1 * _CLASSES))

    def _after(self, at: int, c: str) -> int:
        """The next state; for an unseen character the commonest one of its class, or of all; after the last, the same."""
        follow, counts = self.follow[at], self.counts[at]
        if c in follow:
            return follow[c]
        alike = [x for x in follow if symbols(x) == symbols(c)] or list(follow)
        return follow[max(alike, key=lambda x: (counts[x], x))] if alike else at

    def likelihood(self, s: str) -> float:
        """Mean log-probability of a character and of the end."""
        return self.tails(s, [0])[0]

    def tails(self, s: str, starts: list[int]) -> list[float]:
        """``likelihood`` of what follows each of the ascending ``starts``.

        Walks that reach one state at one place go on as one, so the work is
        bounded by the length times the states, however many starts there are.
        """
        if len(starts) == 1:
            at, total = 0, 0.0
            for c in s[starts[0] :]:
                log, at = self.step(at, c)
                total += log
            return [(total + self.step(at, "")[0]) / (len(s) - starts[0] + 1)]
        walks: dict[int, tuple[float, list]] = {}
        due = 0
        for i, c in enumerate((*s, "")):
            while due < len(starts) and starts[due] == i:
                _join(walks, 0, 0.0, [(due, 0.0)])
                due += 1
            moved: dict[int, tuple[float, list]] = {}
            for at, (total, members) in walks.items():
                log, to = self.step(at, c)
                _join(moved, to, total + log, members)
            walks = moved
        out = [0.0] * len(starts)
        for total, members in walks.values():
            for d, offset in members:
                out[d] = (total + offset) / (len(s) - starts[d] + 1)
        return out


def _join(walks: dict, at: int, total: float, members: list) -> None:
    """Add walks in state ``at``; the smaller group takes the total of the larger and an offset to it."""
    if at in walks:
        other, others = walks[at]
        if len(members) > len(others):
            other, others, total, members = total, members, other, others
        others += [(d, offset + total - other) for d, offset in members]
        total, members = other, others
    walks[at] = total, members


class _Merging:
    """States of an automaton as they are merged; merged ones answer to one of them."""

    def __init__(self, strings: Iterable[str]):
        self.a = Automaton()
        for s in strings:
            self.a.add(s)
        self.parent = list(range(len(self.a.counts)))
        self.seen = [sum(c.values()) for c in self.a.counts]
        self.classes: list[Counter] = [Counter() for _ in self.a.counts]
        for k, of in zip(self.a.counts, self.classes):
            for c, n in k.items():
                of[symbols(c)] += n
        #: Per state, how many strings go on for how many characters.
        self.left: list[Counter] = [Counter() for _ in self.a.counts]
        for s in strings:
            at = 0
            for i, c in enumerate(s):
                self.left[at][len(s) - i] += 1
                at = self.a.follow[at][c]
            self.left[at][0] += 1

    def state(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def compatible(self, x: int, y: int) -> bool:
        """Whether the shares of what comes next differ by chance only, in both states and in all that follow both.

        So must the lengths of what is left; this tells places of a fixed format apart without walking to its end.
        """
        if self._differ(self.left, self.state(x), self.state(y)):
            return False
        todo, done = [(x, y)], set()
        while todo:
            x, y = (self.state(z) for z in todo.pop())
            if x == y or (x, y) in done:
                continue
            done.add((x, y))
            n, m = self.seen[x], self.seen[y]
            # Not even a complete difference would be beyond chance.
            if _choose(n + m, n) < -math.log(CHANCE):
                continue
            if self._differ(self.a.counts, x, y) or self._differ(self.classes, x, y):
                return False
            todo += [(t, self.a.follow[y][c]) for c, t in self.a.follow[x].items() if c in self.a.follow[y]]
        return True

    def _differ(self, of: list[Counter], x: int, y: int) -> bool:
        n, m, p, q = self.seen[x], self.seen[y], of[x], of[y]
        return any(_more(p[c], n, q[c], m) or _more(q[c], m, p[c], n) for c in p.keys() | q.keys())

    def fold(self, x: int, y: int) -> None:
        """Make one state of two, and of what follows both by the same character."""
        todo = [(x, y)]
        while todo:
            x, y = (self.state(z) for z in todo.pop())
            if x == y:
                continue
            self.parent[y] = x
            self.a.counts[x].update(self.a.counts[y])
            self.classes[x].update(self.classes[y])
            self.left[x].update(self.left[y])
            self.seen[x] += self.seen[y]
            for c, t in self.a.follow[y].items():
                if c in self.a.follow[x]:
                    todo.append((self.a.follow[x][c], t))
                else:
                    self.a.follow[x][c] = t
            self.a.follow[y] = {}

    def next(self, x: int) -> list[int]:
        """The states after ``x``, by their least character."""
        return list(dict.fromkeys(self.state(t) for _, t in sorted(self.a.follow[x].items())))


def infer(strings: Iterable[str]) -> Automaton:
    """Merge compatible states of the prefix tree of the strings.

    First the states after one state, from the root down, the commonest first:
    they are at one depth, so counts gather where a format leaves the character
    open, and its literals and lengths stay apart. Then, as usual, a state
    joins the first compatible one that is settled, or is settled itself.
    """
    m = _Merging(sorted(strings))
    level = [0]
    while level:
        below: list[int] = []
        for x in level:
            groups: list[int] = []
            for y in sorted(m.next(x), key=lambda y: (-m.seen[y], y)):
                into = next((g for g in groups if m.compatible(g, y)), None)
                if into is None:
                    groups.append(y)
                else:
                    m.fold(into, y)
            below += groups
        level = list(dict.fromkeys(m.state(y) for y in below))
    settled, waiting = [0], m.next(0)
    while waiting:
        y = waiting.pop(0)
        into = next((x for x in settled if m.compatible(x, y)), None)
        if into is None:
            settled.append(y)
        else:
            m.fold(into, y)
        settled = list(dict.fromkeys(m.state(x) for x in settled))
        done = set(settled)
        waiting = list(dict.fromkeys(t for x in settled for t in m.next(x) if t not in done))
    name = {x: i for i, x in enumerate(settled)}
    return Automaton([m.a.counts[x] for x in settled], [{c: name[m.state(t)] for c, t in m.a.follow[x].items()} for x in settled])


def parts(run: str) -> list[tuple[int, int]]:
    """What of a run can be a credential: the whole, what follows a ``=``, ``/`` or ``-``, and what
    lies between two of them; without ``.``, ``-`` and ``=`` at the end, and the whole also with them."""
    n, end = len(run), len(run.rstrip(".-="))
    cuts = [m.end() for m in _SEPARATOR.finditer(run)]
    found = {(0, n), (0, end), *((x, end) for x in cuts)}
    for x, y in zip([0, *cuts], [*(c - 1 for c in cuts), n]):
        found.add((x, x + len(run[x:y].rstrip(".-="))))
    return sorted(p for p in found if p[1] - p[0] >= SHORTEST)


@dataclass
class SecretModel:
    automata: dict[str, Automaton] = field(default_factory=dict)
    background: Automaton | None = None
    thresholds: dict[str, float] = field(default_factory=dict)
    #: Length of the shortest labelled string of a kind.
    least: dict[str, int] = field(default_factory=dict)
    _known: dict[str, list] = field(default_factory=dict, repr=False)

    def shortest(self) -> int:
        """The length from which any kind can be."""
        return min((self.least.get(k, SHORTEST) for k in self.automata), default=SHORTEST)

    def scored(self, run: str) -> list[tuple[int, int, dict[str, float]]]:
        """The parts of a run with the gain of every kind that has so short strings: how much likelier
        the format makes a character than the background does, to a thousandth. Short runs are kept."""
        got = self._known.get(run)
        if got is None:
            got = self._score(run)
            if len(run) <= KEPT_LENGTH:
                if len(self._known) >= KEPT_RUNS:
                    self._known.clear()
                self._known[run] = got
        return got

    def _score(self, run: str) -> list[tuple[int, int, dict[str, float]]]:
        out, low = [], self.shortest()
        by_end: dict[int, list[int]] = {}
        for a, b in parts(run):
            if b - a >= low:
                by_end.setdefault(b, []).append(a)
        for b, starts in by_end.items():
            # Only the start of the first part matters to the work.
            s, moved = run[starts[0] : b], [a - starts[0] for a in starts]
            back = self.background.tails(s, moved) if self.background else [-math.inf] * len(moved)
            by_kind = {k: m.tails(s, moved) for k, m in self.automata.items()}
            for i, a in enumerate(starts):
                gains = {k: round(v[i] - max(back[i], -12.0), 3) for k, v in by_kind.items() if b - a >= self.least.get(k, SHORTEST)}
                if gains:
                    out.append((a, b, gains))
        return out

    def of_string(self, s: str) -> dict[str, float]:
        """Gain of every kind for one whole string."""
        return next((g for a, b, g in self.scored(s) if (a, b) == (0, len(s))), {})

    def best(self, scored: list[tuple[int, int, dict[str, float]]]) -> list[tuple[str, int, int, float]]:
        """Of the parts at a threshold or above it, the best ones that do not overlap."""
        found = []
        for a, b, gains in scored:
            over = [(g - self.thresholds[k], k) for k, g in gains.items() if k in self.thresholds and g > 0 and g >= self.thresholds[k]]
            if over:
                found.append((*max(over), a, b))
        out: list[tuple[int, int, str, float]] = []
        for over, kind, a, b in sorted(found, key=lambda f: (-f[0], f[2] - f[3], f[2])):
            i = bisect_right(out, (a, b))
            if (i == 0 or out[i - 1][1] <= a) and (i == len(out) or out[i][0] >= b):
                out.insert(i, (a, b, kind, over))
        return [(kind, a, b, over) for a, b, kind, over in out]


def runs(text: str, spans: list, shortest: int = SHORTEST) -> Iterator[tuple[int, str, list | None]]:
    """Start and text of every run of that length, and the base spans in it, as merged starts and ends (None if there is none)."""
    taken: list[list[int]] = []
    for a, b in sorted((a, b) for _, a, b, _ in spans):
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    at = 0
    for m in _RUN.finditer(text):
        a, b = m.span()
        if b - a >= shortest:
            while at < len(taken) and taken[at][1] <= a:
                at += 1
            to = at
            while to < len(taken) and taken[to][0] < b:
                to += 1
            yield a, m[0], [(x - a, y - a) for x, y in taken[at:to]] or None


def _free(a: int, b: int, inside: list | None) -> bool:
    """Whether a part meets none of the base spans."""
    if not inside:
        return True
    i = bisect_right(inside, a, key=lambda s: s[1])
    return i == len(inside) or inside[i][0] >= b


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id", strings: int = SAMPLE_STRINGS) -> SecretModel:
    """Infer an automaton per kind from a bounded sample of the distinct credentials, chosen by their hash.

    Sampled strings have SAMPLE_LENGTH characters at most. The threshold of a
    kind is reached by a thousandth of the background runs (those outside of
    the base spans, by their best parts) and by all but the lowest twentieth of
    its own strings; both are counted over all documents and all lengths. Kinds
    without any string have no automaton.
    """

    def labelled():
        def of(hashes, texts):
            out = ([], [])
            for h, t in zip(hashes, texts):
                spans = base_spans(t or "")
                if spans or h % 50 == 0:
                    for kind, s in _training(t or "", spans):
                        for o, x in zip(out, (kind, s)):
                            o.append(x)
            return out

        return of

    rows = docs.select(F.xxhash64(F.col(key), F.lit(9)).alias("h"), F.col(text).alias("t"))
    rows = rows.where(F.col("t").rlike(r"[0-9a-f]{24}|AKIA|[:=]") | (F.col("h") % 50 == 0))
    found = flat_rows(rows, ["h", "t"], labelled, "kind string, s string").distinct()
    found = cut_lineage(found)
    least = {r.kind: r.n for r in found.where("kind != ''").groupBy("kind").agg(F.min(F.length("s")).alias("n")).collect()}
    learned = found.where(F.length("s") <= SAMPLE_LENGTH)
    picked = [by_hash(learned.where(F.col("kind") == k), ["kind", "s"], strings) for k in KINDS]
    # Half of the background is as long as credentials are, if there is such.
    back = learned.where("kind = ''")
    long = F.length("s") >= min(least.values(), default=SHORTEST)
    picked += [by_hash(back.where(long), ["kind", "s"], strings // 2), by_hash(back, ["kind", "s"], strings // 2)]
    by: dict[str, set[str]] = {}
    for frame in picked:
        for r in frame.collect():
            by.setdefault(r.kind, set()).add(r.s)
    model = SecretModel(background=infer(by[""]) if by.get("") else None, least=least)
    for kind in KINDS:
        if by.get(kind):
            model.automata[kind] = infer(by[kind])
    return _with_thresholds(docs, model, text) if model.automata else model


def _with_thresholds(docs: DataFrame, model: SecretModel, text: str) -> SecretModel:
    """Set the thresholds over the candidates and labelled strings of all documents, from counts per gain."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored():
        known = shared.value
        low = known.shortest()

        def of(texts):
            n: Counter = Counter()
            plain: Counter = Counter()
            for t in texts:
                spans = base_spans(t or "")
                for kind, s in _labelled(t or "", spans):
                    gains = known.of_string(s)
                    if kind in gains:
                        n[kind, True, gains[kind]] += 1
                if not spans:
                    plain.update(r for r in _RUN.findall(t or "") if len(r) >= low)
                    continue
                for _, run, inside in runs(t, spans, low):
                    if inside is None:
                        plain[run] += 1
                    else:
                        n.update(_top(p for p in known.scored(run) if _free(p[0], p[1], inside)))
            for run, times in plain.items():
                for key in _top(known.scored(run)):
                    n[key] += times
            return [*([*x] for x in zip(*n)), [*n.values()]] if n else [[], [], [], []]

        return of

    counts = flat_rows(docs.select(F.col(text).alias("t")), ["t"], scored, "kind string, own boolean, gain double, n long")
    # Gains are rounded, so the table has some ten thousand rows a kind at most.
    held = counts.groupBy("kind", "own", "gain").agg(F.sum("n").alias("n")).collect()

    def quantile(kind: str, own: bool, share: float) -> float:
        rows = sorted((r.gain, r.n) for r in held if r.kind == kind and r.own == own)
        rank, at = math.ceil(share * sum(n for _, n in rows)), 0
        for gain, n in rows:
            at += n
            if at >= rank:
                return gain
        return 0.0

    for kind in model.automata:
        model.thresholds[kind] = max(quantile(kind, True, 0.05), quantile(kind, False, 0.999), 0.0)
    return model


def _top(scored: Iterable[tuple[int, int, dict[str, float]]]) -> list[tuple[str, bool, float]]:
    """The greatest gain of every kind among the parts of a run, as keys of the counts."""
    top: dict[str, float] = {}
    for _, _, gains in scored:
        for kind, gain in gains.items():
            top[kind] = max(top.get(kind, gain), gain)
    return [(kind, False, gain) for kind, gain in top.items()]


def _labelled(text: str, spans: list) -> list[tuple[str, str]]:
    """The credentials under the base spans by kind."""
    matches = [(kind, a, b, _ASSIGN.match(text, a, b) if kind == "assign" else None) for kind, a, b, _ in spans]
    return [(kind, m[2] if m else text[a:b]) for kind, a, b, m in matches]


def _training(text: str, spans: list) -> list[tuple[str, str]]:
    """The credentials under the base spans by kind, and under '' the parts of runs outside of them."""
    parted = [("", run[a:b]) for _, run, inside in runs(text, spans) for a, b in parts(run) if b - a <= SAMPLE_LENGTH and _free(a, b, inside)]
    return _labelled(text, spans) + parted


def find(docs: DataFrame, model: SecretModel, text: str = "text") -> DataFrame:
    """Add ``spans``: the base ones and, outside of them, runs or parts of runs that an automaton finds likely (kind ``like_<kind>``).

    Whole texts are read; a null text counts as empty. Spans are ordered by
    start, then kind as listed; offsets are code points, the end exclusive.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        known = shared.value

        def scan(t: str) -> list:
            spans = base_spans(t)
            if known.thresholds:
                added = []
                for start, run, inside in runs(t, spans, known.shortest()):
                    left = known.scored(run)
                    if inside is not None:
                        left = [p for p in left if _free(p[0], p[1], inside)]
                    added += [(f"like_{k}", start + a, start + b, gain) for k, a, b, gain in known.best(left)]
                spans += added
            order = {k: i for i, k in enumerate((*KINDS, *(f"like_{k}" for k in KINDS)))}
            return as_rows(sorted(spans, key=lambda s: (s[1], order[s[0]])))

        return lambda texts: [[scan(t or "") for t in texts]]

    return with_columns(docs, [text], make, f"spans {SPANS}")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = find(docs, fit(docs)).select("doc_id", "spans")
    base = of_kind(F.col("spans"), KINDS)
    counts = [F.size(of_kind(F.col("spans"), [k])).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
