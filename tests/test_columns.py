"""Null, tie and bin rules on hand-made rows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from turfline.functions import columns as c


def one(spark, expr, **values):
    names = list(values)
    types = {int: "int", float: "double", str: "string", bool: "boolean"}
    schema = ", ".join(f"{n} {types[type(v)]}" if v is not None else f"{n} string" for n, v in values.items())
    return spark.createDataFrame([tuple(values[n] for n in names)], schema).select(expr.alias("v")).first()["v"]


def test_choice_keeps_null(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "b boolean")
    assert [r[0] for r in df.select(c.if_else(F.col("b"), F.lit(1), F.lit(2))).collect()] == [1, 2, None]


def test_cut_is_open_below_and_closed_above(spark):
    df = spark.createDataFrame([(float(v),) for v in (-50, -49, -10, 10, 50, 51)] + [(None,)], "w double")
    got = [r[0] for r in df.select(c.cut("w", (-50, -10, 10, 50), ("left", "middle", "right"))).collect()]
    assert got == [None, "left", "left", "middle", "right", None, None]


def test_cut_can_include_the_lowest_edge(spark):
    df = spark.createDataFrame([(0.5,), (1.5,)], "w double")
    got = [r[0] for r in df.select(c.cut("w", (0.5, 1.5, 2.5), ("a", "b"), include_lowest=True)).collect()]
    assert got == ["a", "a"]


def test_cut_wants_one_label_per_bin():
    with pytest.raises(ValueError):
        c.cut("w", (0, 1), ("a", "b"))


def test_ranks_with_ties_and_null(spark):
    df = spark.createDataFrame([("g", 1), ("g", 2), ("g", 2), ("g", None)], "g string, v int")
    got = df.select("v", c.min_rank("v", ["g"]).alias("m"), c.avg_rank("v", ["g"]).alias("a")).collect()
    assert sorted((r["m"], r["a"]) for r in got) == [(1, 1.0), (2, 2.5), (2, 2.5), (4, 4.0)]
    down = df.select("v", c.min_rank("v", ["g"], desc=True).alias("m")).collect()
    assert {(r["v"], r["m"]) for r in down} == {(2, 1), (1, 3), (None, 4)}


def test_sub_replaces_the_first_match_only(spark):
    assert one(spark, c.sub_first("s", "Cover ", "Cover-"), s="Cover 3 Cover 2") == "Cover-3 Cover 2"


def test_paste_spells_missing_as_text(spark):
    assert one(spark, c.paste("a", "b", sep=" - "), a=3, b=None) == "3 - NA"


def test_ordinals(spark):
    df = spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 11, 12, 13, 21, 102, 111)], "n int")
    assert [r[0] for r in df.select(c.ordinal("n")).collect()] == [
        "1st", "2nd", "3rd", "4th", "11th", "12th", "13th", "21st", "102nd", "111th",
    ]


def test_yard_labels(spark):
    df = spark.createDataFrame([(30,), (60,), (61,), (-30,), (None,)], "y int")
    assert [r[0] for r in df.select(c.yard_label("y")).collect()] == [20, 50, 49, 20, None]


def test_strict_mean_is_null_with_a_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 1.0), ("b", None)], "g string, v double")
    assert {tuple(r) for r in df.groupBy("g").agg(c.strict_mean("v")).collect()} == {("a", 2.0), ("b", None)}


def test_shares_sum_to_one(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", 5)], "g string, n int")
    got = df.withColumn("p", c.share("n", ["g"])).withColumn("t", F.sum("p").over(Window.partitionBy("g")))
    assert {r["t"] for r in got.collect()} == {1.0}


def test_number_texts(spark):
    assert one(spark, c.big_number("n"), n=1234567) == "1,234,567"
    assert one(spark, c.percent("p"), p=0.873) == "87.3%"
    assert one(spark, c.scientific("p"), p=0.01234) == "1.23e-02"


def test_written_tables_have_an_owner(spark):
    from pathlib import Path

    from turfline.functions import lineage

    kept = lineage.cut_lineage(spark.range(5))
    assert kept.count() == 5
    folder = Path(lineage._own_folder(spark).removeprefix("file:"))
    assert any(folder.iterdir())
