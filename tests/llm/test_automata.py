"""Automata inferred from credentials: their states, their probabilities, and long runs."""

import math
import random
import time

import pytest

from turfline.llm import credentials

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
MIXED = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def drawn(r, alphabet, n):
    return "".join(r.choices(alphabet, k=n))


@pytest.mark.parametrize("n", [30, 1500])
def test_states_of_a_format(n):
    """A literal prefix of four and sixteen open characters: a state for each of them, and one for the end."""
    r = random.Random(3)
    a = credentials.infer(["AKIA" + drawn(r, UPPER, 16) for _ in range(n)])
    assert len(a.counts) == 21
    assert [set(c) for c in a.counts[:4]] == [{"A"}, {"K"}, {"I"}, {"A"}]
    assert set(a.counts[20]) == {""}
    good = a.likelihood("AKIA" + drawn(r, UPPER, 16))
    assert good > a.likelihood("BKIA" + drawn(r, UPPER, 16)) + 0.1
    assert good > a.likelihood("AKIA" + drawn(r, UPPER, 12)) + 0.1
    assert good > a.likelihood("AKIA" + drawn(r, UPPER, 24)) + 0.1


def test_two_formats_stay_apart():
    r = random.Random(4)
    a = credentials.infer(["AKIA" + drawn(r, UPPER, 16) for _ in range(200)] + ["ghp_" + drawn(r, MIXED, 36) for _ in range(200)])
    assert 55 <= len(a.counts) <= 70  # the start, 19 and 39 states after it, one end, and a few that chance keeps apart
    whole = "ghp_" + drawn(r, MIXED, 36)
    odds = lambda s: a.likelihood(s) * (len(s) + 1) + len(s) * math.log(62)  # noqa: E731  # beside evenly drawn characters
    assert odds(whole) > odds(whole[:20]) + 3
    assert a.likelihood("AKIA" + drawn(r, UPPER, 16)) > a.likelihood("AKhp" + drawn(r, UPPER, 16)) + 0.1


def test_probabilities_sum_to_one_or_less():
    r = random.Random(5)
    a = credentials.infer(["AKIA" + drawn(r, UPPER, 16) for _ in range(40)])
    for state in range(len(a.counts)):
        total = sum(math.exp(a.step(state, c)[0]) for c in [*MIXED, *"+/_.=-", ""])
        assert 0.9 < total < 1.02


def test_tails_are_likelihoods():
    r = random.Random(6)
    a = credentials.infer([drawn(r, "0123456789abcdef", r.choice([18, 40])) for _ in range(100)])
    s = "-".join(drawn(r, MIXED, r.randrange(1, 30)) for _ in range(20))
    starts = sorted(r.sample(range(len(s)), 25))
    assert a.tails(s, starts) == pytest.approx([a.likelihood(s[x:]) for x in starts])


def test_few_strings():
    """One string gives no evidence that its places differ; ten do."""
    assert len(credentials.infer(["abc"]).counts) == 1
    assert len(credentials.infer(["abc"] * 10).counts) == 4
    assert len(credentials.infer([]).counts) == 1


def test_long_runs_take_linear_time():
    r = random.Random(7)
    a = credentials.infer([drawn(r, "0123456789abcdef", 40) for _ in range(100)])
    model = credentials.SecretModel({"hex": a}, a, {"hex": 0.0}, {"hex": 40})
    start = time.time()
    assert len(model.best(model.scored("abc/def-=xyz9" * 2000))) >= 0
    assert time.time() - start < 30


def test_long_credential_after_a_name(spark):
    """A block of 900 characters after ``AUTH=``, as those that a keyword labels."""
    r = random.Random(8)
    key = lambda: drawn(r, UPPER, 900)
    word = lambda: drawn(r, "etaoinshrdlu", 12)
    short = lambda: drawn(r, UPPER, 300)
    rows = [(i, f"{word()} token={short()} {word()}") for i in range(60)] + [(i, f"{word()} secret: {key()} {word()}") for i in range(60, 64)]
    hidden = [key() for _ in range(4)]
    rows += [(100 + i, f"{word()} AUTH={k} {word()}") for i, k in enumerate(hidden)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = credentials.fit(df)
    assert model.least == {"assign": 300}
    got = {r.doc_id: r.spans for r in credentials.find(df, model).collect()}
    longest = [max(got[100 + i], key=lambda s: s.end - s.start, default=None) for i in range(4)]
    assert all(s is None or s.kind == "like_assign" for s in longest)
    assert all(g for a, b, g in model.scored("AUTH=" + hidden[0]) if b - a == 900)


def test_bare_credentials_of_a_prefix_format(spark):
    """Keys with a literal prefix that only a keyword labels elsewhere; no pattern finds them alone.

    They are under a thousandth of the other runs of their length, as the threshold has it.
    """
    r = random.Random(9)
    key = lambda: "ghp_" + drawn(r, MIXED, 36)
    word = lambda n: drawn(r, "etaoinshrdlu", n)
    rows = [(i, f"{word(8)} token={key()} {' '.join(word(45) for _ in range(60))}") for i in range(200)]
    rows += [(1000 + i, f"{word(8)} {key()} {word(45)}") for i in range(10)] + [(2000 + i, f"{word(8)} {drawn(r, MIXED, 40)} {word(9)}") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = credentials.fit(df)
    got = {r.doc_id: r.spans for r in credentials.find(df, model).collect()}
    text = dict(rows)
    hits = [i for i in range(1000, 1010) if [(s.kind, text[i][s.start : s.end]) for s in got[i]] == [("like_assign", text[i].split()[1])]]
    assert len(hits) >= 8
    fits = [model.automata["assign"].likelihood(text[i].split()[1]) for i in [*range(1000, 1010), *range(2000, 2010)]]
    assert min(fits[:10]) > max(fits[10:])  # the prefix tells them from other strings of these characters
