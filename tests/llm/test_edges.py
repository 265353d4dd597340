"""Nulls, empty and very long texts, repeated rows, empty tables, and columns named like an operator's own."""

import pytest
from pyspark.sql import functions as F

from turfline.llm import chosen_path, credentials, imatch, language, mixing, nearest, pieces, private, quality, suffixes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, spans string, stats string, fingerprint string, token_bytes string, removed string, draws string, lang_pred string"
EXTRA = (9.0, 7, "s", "s", "s", "s", "s", "s", "s")
LONG = "ein sehr langer Text mit Wörtern und 12 34 a@b.cd token=abcdef123 " * 6000


def documents(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, "one two three four five six", "en", "a", 3), (1, "one two three four five six", "en", "a", 3), (None, "une phrase", None, None, None),
        (None, None, None, None, None), (2, None, "de", "b", 0), (3, "", "de", None, 0), (4, "  \n\t ", "fr", "b", 5), (5, "!!! ???", "fr", "b", 5),
        (6, LONG, "de", "a", len(LONG)), (7, LONG, "de", "c", len(LONG)), (8, "x" * 100_000, "en", "c", 1), (9, "🙂 é", "en", "c", 1),
    ]
    return documents(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


def labels(df):
    return df.select("doc_id", F.lit(1).alias("quality"))


OPERATORS = {
    "jaccard": lambda df: chosen_path.join(df),
    "imatch": lambda df: imatch.fingerprints(df),
    "neighbour": lambda df: imatch.with_next(df, "doc_id", ["text"]),
    "quality": lambda df: quality.score(df, quality.fit(df, labels(df))),
    "draw": lambda df: mixing.draw(df),
    "pieces": lambda df: pieces.decode(pieces.encode(df)),
    "suffixes": lambda df: suffixes.remove_repeats(df),
    "private": lambda df: private.redact(df, private.fit(df)),
    "secrets": lambda df: credentials.find(df, credentials.fit(df)),
    "language": lambda df: language.identify(df, language.fit(df)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_a_result(odd, none, name):
    assert OPERATORS[name](odd).count() == odd.count()
    assert OPERATORS[name](none).count() == 0


def test_columns_pass(odd):
    for name in ("imatch", "quality", "pieces", "suffixes", "secrets", "language"):
        out = OPERATORS[name](odd)
        assert len(set(out.columns)) == len(out.columns)
        assert {"doc_id", "text", "lang", "source", "n_chars"} <= set(out.columns)


def test_defined_results(odd):
    got = {(r.doc_id, r.text): r for r in OPERATORS["language"](odd).collect()}
    for key in ((2, None), (3, ""), (4, "  \n\t "), (5, "!!! ???")):
        assert (got[key].lang_pred, got[key].score) == ("und", 0.0)
    got = {(r.doc_id, r.class_id, r.n_links) for r in OPERATORS["jaccard"](odd).collect()}
    assert {(2, 2, 0), (3, 3, 0), (4, 4, 0), (1, 1, 1), (6, 6, 1), (7, 6, 1), (None, None, 0)} <= got
    got = {(r.doc_id, r.text): r for r in OPERATORS["suffixes"](odd).collect()}
    assert bytes(got[6, LONG].kept) == bytes(got[7, LONG].kept) == b""
    assert bytes(got[2, None].kept) == b"" and got[2, None].removed == []
    assert bytes(got[8, "x" * 100_000].kept) == b""
    got = {(r.doc_id, r.text): r for r in OPERATORS["draw"](odd).collect()}
    assert got[2, None]["size"] == got[4, "  \n\t "]["size"] == 0 and got[None, "une phrase"]["size"] == 2


def test_empty_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest.search(df, df).count() == 0


def test_one_language_and_no_labels(spark):
    df = spark.createDataFrame([(i, "same words", "en" if i else None) for i in range(4)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.identify(df, language.fit(df)).collect()} == {"en"}
    none = df.where("false").selectExpr("doc_id", "1 as quality")
    assert {r.score for r in quality.score(df, quality.fit(df, none)).collect()} == {0.5}


def test_language_sample_is_bounded_without_keys(spark, monkeypatch):
    """Rows without key, repeated rows and rows with one key leave the sample within its bound."""
    rows = [(None, f"word number {i} in a line", "en", "a", 1) for i in range(3000)]
    rows += [(7, "ein und derselbe Satz", "de", "a", 1)] * 2000 + [(8, f"ein Satz mit der Zahl {i}", "de", "a", 1) for i in range(2000)]
    seen = []
    original = language._ftrl
    monkeypatch.setattr(language, "_ftrl", lambda data, *rest: seen.append(len(data)) or original(data, *rest))
    model = language.fit(documents(spark, rows), rows_per_language=20)
    assert model.languages == ["de", "en"] and 0.8 * 30 <= seen[0] <= 0.8 * 40
    assert model.predict("eine Zahl und ein Satz")[0] == "de"


def test_turns_are_bounded_by_rows_and_bytes():
    import pyarrow as pa

    from turfline.llm.common import turns

    texts = pa.array(["a" * 10, None, "b" * 50, "c" * 5, "d" * 5, "", "e"])
    assert list(turns([texts], 3, 30)) == [(0, 2), (2, 1), (3, 3), (6, 1)]
    assert list(turns([texts.slice(3)], 9, 30)) == [(0, 4)] and list(turns([texts.slice(7)])) == []


def test_a_long_text_without_blanks(spark):
    """Ten megabytes in one chunk are encoded and decoded, and not kept."""
    text = "ab\tcd\n" * 1_700_000
    df = documents(spark, [(1, text, "en", "a", 1), (2, "short", "en", "a", 1)])
    out = pieces.decode(pieces.encode(df)).select("doc_id", F.length("decoded").alias("n"), "n_tokens").collect()
    assert {r["doc_id"]: r["n"] for r in out} == {1: len(text), 2: 5}


def test_texts_nobody_asks_for_are_not_moved(spark):
    rows = spark.range(20_000).selectExpr("id AS k", "repeat(id, 3) AS t", "xxhash64(id) AS th")
    slim = rows.union(spark.range(7, 8).selectExpr("null", "'none'", "xxhash64(id)"))
    wanted = rows.where("k % 100 = 7").select("k", "th").union(spark.range(7, 8).selectExpr("null", "xxhash64(id)"))
    asked = chosen_path._asked(slim, wanted.select("th"))
    assert len({r["k"] for r in asked.collect()}) < 400  # by chance 0.2 of the others have a bit that is set
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        texts = chosen_path._texts(slim, wanted)
        plan = str(texts._jdf.queryExecution().executedPlan()).splitlines()
        assert sorted(r["t"] for r in texts.collect()) == sorted([*[str(i) * 3 for i in range(7, 20_000, 100)], "none"])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = [i for i, line in enumerate(plan) if "Exchange hashpartitioning(k" in line]
    assert any("BroadcastHashJoin" in line for line in plan[moved[0] : moved[1]])  # the map stands below the exchange of the texts


def test_a_draw_is_a_small_expression(spark):
    quotas = spark.createDataFrame([(i, 100 * i) for i in range(12)], "src_no int, quota long")
    plan = str(mixing.split_quotas(quotas, 40)._jdf.queryExecution().toString())
    assert len(plan) < 300_000  # nearly 700,000 with every value in place, see mixing._bound


def test_batches_handed_to_python_are_small(spark):
    import sys

    from turfline.llm import common

    rows = spark.range(0, 9000, 1, 1).selectExpr("id AS doc_id", "repeat(cast(id % 10 AS string), 2000) AS text")

    def make():
        # The batch that the chunk of texts was cut from.
        return lambda texts: [[sys._getframe(1).f_locals["batch"].nbytes] * len(texts)]

    out = common.with_columns(rows, ["text"], make, "held long").agg(F.count("held"), F.max("held"), F.min("doc_id"), F.max("doc_id")).first()
    assert out[0] == 9000 and out[2:] == (0, 8999)
    assert out[1] < 2 * common.BATCH_BYTES  # 18 MB under Spark's own bound
    assert [common._in_bytes(x) for x in ("64MB", "3k", "17", "2097152b", "-1")] == [64 << 20, 3 << 10, 17, 2 << 20, float("inf")]


def test_redacting_takes_one_python_pass(odd):
    model = private.fit(odd)
    out = private.redact(odd, model)
    assert str(out._jdf.queryExecution().executedPlan()).count("MapInArrow") == 1
    texts = odd.select("text").collect()
    spans = [private.scan(r.text or "", model) for r in texts]
    assert sorted(map(str, ((r.text, [s.kind for s in r.spans]) for r in out.collect()))) == sorted(
        str((private.redacted(r.text, s), [x[0] for x in s])) for r, s in zip(texts, spans)
    )
