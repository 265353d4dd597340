"""The scan for personal data takes linear time and finds what the plain patterns find."""

import random
import re
import time

import pytest

from turfline.llm import private

PLAIN_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
PLAIN_TRIM = re.compile(r"[^A-Za-z0-9+(]*(.*?)[^A-Za-z0-9]*\Z", re.S)


def test_addresses_as_the_plain_pattern():
    r = random.Random(1)
    for _ in range(20_000):
        t = "".join(r.choices("0129.. x", k=r.randrange(25)))
        plain = [m.span() for m in PLAIN_IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
        assert [(a, b) for k, a, b, _ in private.base_spans(t) if k == "ip"] == plain


def test_trimmed_as_the_plain_pattern():
    r = random.Random(2)
    for _ in range(20_000):
        t = "".join(r.choices("a1+(-.\n²é", k=r.randrange(9)))
        m = PLAIN_TRIM.match(t[1:])
        if t:
            assert private._trimmed(t, 1, len(t)) == (1 + m.start(1), 1 + m.end(1))


def test_merged_meets_what_the_spans_meet():
    r = random.Random(3)
    for _ in range(2_000):
        spans = [("ip", a, a + r.randrange(1, 9), 1.0) for a in (r.randrange(60) for _ in range(r.randrange(6)))]
        covered = {i for _, a, b, _ in spans for i in range(a, b)}
        merged = private._merged(spans)
        assert {i for a, b in merged for i in range(a, b)} == covered
        assert all(x[1] <= y[0] for x, y in zip(merged, merged[1:]))


@pytest.mark.parametrize("text", ["7" * 1_000_000, "7." * 500_000, "1" + "-" * 500_000 + "1", "+" * 500_000, "a" * 500_000 + "@"])
def test_long_texts(text):
    start = time.time()
    private.base_spans(text)
    for run in private.sequences(text):
        private._trimmed(text, run[0][0], run[-1][1])
    assert time.time() - start < 10


def test_a_text_with_many_spans(spark):
    """Thousands of addresses in one text, each apart from the others."""
    line = "host 10.0.0.1 mail ann@example.com seen\n"
    df = spark.createDataFrame([(1, line * 5000)], "doc_id long, text string")
    model = private.SpanModel(private.np.zeros((private.BUCKETS, 5)), private.np.zeros((5, 5)))
    start = time.time()
    spans = private.find(df, model).first().spans
    assert [sum(s.kind == k for s in spans) for k in private.KINDS] == [5000, 5000, 0, 0]
    assert time.time() - start < 60
