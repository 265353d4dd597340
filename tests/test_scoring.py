"""Prediction scoring, sampling and model fits."""

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from turfline.functions import sampling as sp
from turfline.operators import grids as gr
from turfline.operators import logistic as lg
from turfline.operators import scoring as sc

LONG = "model string, date string, set string, clip_id int, class string, actual string, odds double"


def test_unnamed_class_is_class_one(spark, rows):
    wide = spark.createDataFrame([("m", "d", "assess", 7, "1", 0.4)], "MODEL string, date string, set string, clip_id int, actual string, PRED double")
    assert rows(sc.preds_long(wide)) == [("m", "d", "assess", 7, "1", "1", 0.4)]
    many = spark.createDataFrame([("m", "d", "assess", 7, "1", 0.4, 0.6)], "model string, date string, set string, clip_id int, actual string, pred0 double, pred12 double")
    assert rows(sc.preds_long(many), "class", "odds") == [("0", 0.4), ("12", 0.6)]


@pytest.fixture
def mapped_input(spark):
    rows = [
        ("all_class", "2025-01-01", "assess", 1, "0", "0", 0.9),
        ("all_class", "2025-02-01", "assess", 1, "0", "0", 0.3),
        ("all_class", "2025-02-01", "assess", 1, "1", "0", 0.3),
        ("hier", "2025-02-01", "assess", 1, "1", "1", 0.8),
        ("hier", "2025-02-01", "test", 2, "1", "1", 0.8),
    ]
    names = [("all_class", "0", "Cover-1"), ("all_class", "1", "Quarters"), ("hier", "1", "Cover-3; Cover-1")]
    return spark.createDataFrame(rows, LONG), spark.createDataFrame(names, "model string, class string, coverages string")


def test_latest_file_and_ties(mapped_input, rows):
    long, names = mapped_input
    mapped = sc.preds_mapped(sc.preds_latest(long), names)
    got = rows(mapped, "model", "actual_coverage", "pred_coverage", "match")
    assert got == [("all_class", "Cover-1", "Cover-1", True), ("all_class", "Cover-1", "Quarters", False), ("hier", "1-High", "1-High", True)]


def test_collapse_of_both_labels_or_one(mapped_input, rows):
    long, names = mapped_input
    latest = sc.preds_latest(long)
    both = {r["model"]: (r["count"], r["correct"]) for r in sc.model_comparison(sc.preds_mapped(latest, names)).collect()}
    one = {r["model"]: (r["count"], r["correct"]) for r in sc.model_comparison(sc.preds_mapped(latest, names, collapse="actual")).collect()}
    assert both == {"all_class": (2, 1), "hierarchical": (1, 1)}
    assert one == {"all_class": (2, 1), "hierarchical": (1, 0)}


def test_outcome_names(spark):
    df = spark.createDataFrame([(0.2, 0), (0.2, 1), (0.8, 0), (0.8, 1)], "pred1 double, actual int")
    assert [r["class"] for r in sc.binary_outcome_class(df).collect()] == ["2 High", "Wrong", "Wrong", "1 High"]


def test_spread_sign(spark):
    df = spark.createDataFrame([("a", 0, 0.5), ("a", 0, 0.7), ("a", 0, 0.9)], "actual string, backs int, pct double")
    assert sorted(round(r["diff"], 6) for r in sc.accuracy_spread(df).collect()) == [-0.4, 0.4, 0.4]


def test_having_total_keeps_rows(spark, rows):
    df = spark.createDataFrame([("a", 3), ("a", 4), ("b", 5), (None, 9)], "g string, n int")
    assert rows(sc.having_total(df, ["g"], "n", 6)) == [("a", 3), ("a", 4), (None, 9)]


def test_recall_and_confusion(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", None)], "actual string, pred string")
    assert {tuple(r) for r in sc.class_recall(df, "actual").collect()} == {("a", 2, 1, 0.5), ("b", 2, 1, 0.5)}
    wide = sc.confusion_pct(df, ["actual"], "pred", ["a", "b"], fill=0.0)
    assert {tuple(r) for r in wide.collect()} == {("a", 0.5, 0.5), ("b", 0.0, 0.5)}


def test_nth_play(spark):
    df = spark.createDataFrame([(1, p, v) for p, v in ((1, 0.3), (2, 0.1), (3, 0.1))], "gameid int, playid int, pred1 double")
    assert sc.nth_play(df, [F.col("pred1").asc()], 2).first()["playid"] == 3
    assert sc.nth_play(df, [F.col("pred1").asc()], 9).count() == 0


def test_accuracy_lies_between_zero_and_one(warehouse):
    got = sc.accuracy(warehouse.preds.withColumn("pred", sc.call()), ["pff_passcoverage"]).collect()
    assert all(0 <= r["pct"] <= 1 for r in got)


def test_split_is_repeatable_and_close_to_the_shares(spark):
    df = spark.range(20_000).selectExpr("1 AS gameid", "id AS playid")
    split = sp.train_split(df, ("gameid", "playid"))
    n = {r["set"]: r["count"] for r in split.groupBy("set").count().collect()}
    assert abs(n["test"] / 20_000 - 0.2) < 0.02 and abs(n["ana"] / 20_000 - 0.6) < 0.02
    assert split.exceptAll(sp.train_split(df.repartition(5), ("gameid", "playid"))).count() == 0
    folds = [r["count"] for r in sp.kfold(df, ("gameid", "playid")).groupBy("fold").count().collect()]
    assert len(folds) == 5 and max(folds) - min(folds) < 400


def test_samples(spark):
    df = spark.range(100).selectExpr("id % 10 AS gameid", "id AS playid")
    assert sp.sample_rows(df, ("gameid", "playid"), 3).count() == 3
    assert sp.sample_group(df, ("gameid",)).count() == 10
    assert sp.sample_rows(df, ("gameid", "playid")).collect() == sp.sample_rows(df.repartition(7), ("gameid", "playid")).collect()


def test_zscore(spark):
    df = spark.createDataFrame([(1.0, 5), (2.0, 5), (3.0, 5)], "a double, b int")
    assert [tuple(r) for r in sp.zscore(df, ["a", "b"]).collect()] == [(-1.0, None), (0.0, None), (1.0, None)]


def test_grids(spark):
    assert gr.scenario_grid(spark).count() == 3060
    assert gr.composition_grid(spark).count() == 15


def test_two_estimators_agree(spark):
    df = spark.range(400).selectExpr(
        "CAST(id % 3 AS DOUBLE) AS blitz", "CAST(id % 4 AS DOUBLE) AS middle", "CAST(id % 5 AS DOUBLE) AS hooks",
        "CAST(id % 7 AS DOUBLE) AS flat", "CAST(id * 7919 % 11 + id % 3 > 6 AS INT) AS hierarchy",
    )
    glm = lg.logistic_fit(df)
    rows = VectorAssembler(inputCols=list(lg.FEATURES), outputCol="features").transform(df)
    other = LogisticRegression(labelCol="hierarchy", regParam=0.0, tol=1e-12, maxIter=200).fit(rows)
    assert glm.weights == pytest.approx([other.intercept, *other.coefficients], abs=1e-5)
    scored = lg.logistic_predict(glm, df)
    assert scored.where((F.col("odds") > 0.5) != (F.col("pred") == 1)).count() == 0


def test_importance_text(spark, rows):
    df = spark.createDataFrame([("a", 0.0123, None)], "category string, importance_mean double, importance_sd double")
    assert rows(sc.importance_report(df)) == [("a", "1.23e-02", "")]


def test_scenario_curve_keeps_few_first_downs(spark, rows):
    df = spark.createDataFrame([(1, 4), (1, 5), (2, 4)], "down int, yardstogo int")
    assert rows(sc.scenario_curve(df)) == [("1st", 5), ("2nd", 4)]


def test_five_numbers(spark, rows):
    df = spark.createDataFrame([("a", v) for v in (1, 2, 3, 4, 10)] + [("a", None)], "g string, v int")
    assert rows(sc.five_numbers(df, ["g"], "v")) == [("a", 5, 1, 2.0, 3.0, 4.0, 10)]


def test_fit_sees_counted_cases_only(spark):
    """A row may be missing a value or stand for thousands; the fit is that of the cases."""
    df = spark.range(4000).selectExpr("CAST(id % 4 AS DOUBLE) AS a", "CAST(id % 3 AS DOUBLE) AS b", "CAST(id % 5 + id % 4 > 3 AS INT) AS hierarchy")
    df = df.unionByName(spark.createDataFrame([(None, 1.0, 1), (1.0, 1.0, None)], df.schema))
    assert lg.cases(df, ("a", "b")).count() == 12
    few = df.where("a IS NOT NULL AND hierarchy IS NOT NULL").limit(0)
    assert lg.logistic_fit(few, ("a", "b")).weights == (0.0, 0.0, 0.0)
    fit, rows = lg.logistic_fit(df, ("a", "b")), df.dropna()
    # At the maximum, the odds add up to the positive rows, in all and weighted by each feature.
    sums = lg.logistic_predict(fit, rows).agg(*[F.sum((F.col("odds") - F.col("hierarchy")) * w) for w in (F.lit(1), F.col("a"), F.col("b"))]).first()
    assert [abs(v) < 1e-6 for v in sums] == [True] * 3


@pytest.mark.parametrize("accuracy", [20, 1_000])
def test_quartiles_of_continuous_values(spark, accuracy):
    df = spark.range(7000).selectExpr("IF(id % 3 = 0, NULL, CAST(id % 4 AS STRING)) AS g", "IF(id % 50 = 0, NULL, sin(id) * exp(id % 11)) AS v", "id % 2 AS s")
    got = {(r["g"], r["s"]): r[2:] for r in sc.five_numbers(df, ["g", "s"], "v", accuracy).collect()}
    frame = df.toPandas().dropna(subset=["v"])
    groups = frame.groupby(["g", "s"], dropna=False)["v"]
    assert len(got) == len(groups)
    for (g, s), v in groups:
        expected = (len(v), v.min(), *v.quantile([0.25, 0.5, 0.75]), v.max())
        assert got[(g if isinstance(g, str) else None, s)] == pytest.approx(expected, rel=1e-12)
