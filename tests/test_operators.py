"""Edge cases and behaviour of the operators that SQL oracles don't reach."""

import pytest
from pyspark.sql import functions as F

from evalloom.functions import scalars as C
from evalloom.operators import bootstrap, ranking, runs, splits
from evalloom.plans import methods
from evalloom.sources import tables
from evalloom.streaming.leaderboard import incremental, latest


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text, months", [("18 Years", 216.0), ("6 Months", 6.0), ("7", 7.0), ("N/A", None), (None, None)])
def test_months(spark, text, months):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(C.months(F.col("t")).alias("x")).first()["x"] == months


def test_guarded_numbers(spark):
    df = spark.createDataFrame([("5d",), ("nan",), ("1e3",), (" .5 ",), (None,), ("",)], "t string")
    assert [r["x"] for r in df.select(C.to_number(F.col("t")).alias("x")).collect()] == [None, None, 1000.0, 0.5, None, None]


def test_ties_and_missing_class(spark):
    df = spark.createDataFrame([("a", 0.9, 1), ("a", 0.5, 0), ("a", 0.5, 1), ("a", 0.5, 0), ("a", 0.1, 1), ("b", 0.3, 1)], "g string, s double, y int")
    got = {r["g"]: r for r in ranking.ranking_metrics(df, ["g"], "s", "y").collect()}
    assert got["a"]["ap"] == pytest.approx((1 + 2 / 4 + 3 / 5) / 3) and got["a"]["auroc"] == pytest.approx((2 + 1 + 0) / 6)
    assert got["b"]["ap"] == 1.0 and got["b"]["auroc"] is None


def test_weights_of_billions_do_not_overflow(spark):
    df = spark.createDataFrame([(0.9, 1, 4_000_000_000), (0.5, 0, 4_000_000_000), (0.4, 1, 4_000_000_000)], "s double, y int, w long")
    for sections in (64, 0):
        got = ranking.ranking_metrics(df.withColumn("g", F.lit("x")), ["g"], "s", "y", F.col("w"), sections).first()
        assert got["ap"] == pytest.approx((1 + 2 / 3) / 2) and got["auroc"] == pytest.approx(0.5)


def test_sectioned_totals_equal_one_window(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 613).cast("double").alias("s"), (F.col("id") % 3 == 0).cast("int").alias("y"), F.lit(1).alias("g"))
    a, b = ranking.ranking_metrics(df, [], "s", "y").first(), ranking.ranking_metrics(df, ["g"], "s", "y", sections=0).first()
    assert a["ap"] == pytest.approx(b["ap"]) and a["auroc"] == pytest.approx(b["auroc"])


def test_bootstrap_detects_a_gap_and_no_gap(spark):
    df = spark.range(400).select("id", (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 2 * 0.5 + F.rand(1) * 0.6).alias("good"), F.rand(2).alias("noise"), F.rand(3).alias("noise2")).cache()
    gap = bootstrap.interval(bootstrap.paired(df, "id", "good", "noise", "y", 40, "t"), "delta").first()
    none = bootstrap.interval(bootstrap.paired(df, "id", "noise", "noise2", "y", 40, "t"), "delta").first()
    assert gap["lo"] > 0 and none["lo"] < 0 < none["hi"] and gap["used"] == gap["requested"] == 40


def test_single_class_draws_are_left_out(spark):
    df = spark.createDataFrame([(1, 0.1, 1), (2, 0.4, 1)], "id int, s double, y int")
    got = bootstrap.interval(bootstrap.resampled(df, "id", "s", "y", 10, "t"), "auroc").first()
    assert got["used"] == 0 and got["requested"] == 10 and got["mean"] is None


def test_family_folds_are_balanced(spark):
    df = spark.range(100).select((F.col("id") % 13).cast("string").alias("f"))
    loads = [r["s"] for r in splits.family_folds(df, "f", 4).groupBy("fold").agg(F.sum("n").alias("s")).collect()]
    assert len(loads) == 4 and max(loads) - min(loads) <= 8
    with pytest.raises(ValueError):
        splits.family_folds(df, "f", 4, most=5)


def test_resume_refuses_another_configuration(spark):
    grid = spark.createDataFrame([("m", 1, "v2"), ("m", 2, "v2")], "method string, seed int, config string")
    done = spark.createDataFrame([("m", 1, None)], "method string, seed int, config string")
    assert [r["seed"] for r in runs.to_run(grid, done, ["method", "seed"], "config").collect()] == [2]
    with pytest.raises(Exception, match="another configuration"):
        runs.to_run(grid, done.fillna("v1"), ["method", "seed"], "config").collect()


def test_unpriced_calls_fail(spark):
    calls = spark.createDataFrame([("m", 10, 1)], "model string, tokens_in long, tokens_out long")
    prices = spark.createDataFrame([("other", 1.0, 1.0)], "model string, usd_in double, usd_out double")
    with pytest.raises(Exception, match="no price"):
        runs.cost(calls, prices, "model", "model").collect()


def test_methods_skip_and_refuse_duplicates(spark):
    with pytest.raises(methods.Skipped):
        methods.METHODS["xgboost"](1.0)
    with pytest.raises(ValueError):
        methods.register("majority")(None)


def test_sources(spark, tmp_path):
    (tmp_path / "x.csv").write_text("nctid,a\nN2,5\nN1,7\nN9,1\n")
    (tmp_path / "y.csv").write_text("nctid,other,rate\nN1,0,1\nN2,0,0\n")
    got = tables.aligned_pair(spark, str(tmp_path / "x.csv"), str(tmp_path / "y.csv"), "nctid", ["missing", "rate"])
    assert {(r["nctid"], r["a"], r["label"]) for r in got.collect()} == {("N1", "7", "1"), ("N2", "5", "0")}
    (tmp_path / "t.txt").write_text("nct_id|name\nN1|a\n")
    assert tables.delimited(spark, str(tmp_path / "t.txt"), ["name"]).columns == ["name"]
    with pytest.raises(ValueError, match="phase"):
        tables.delimited(spark, str(tmp_path / "t.txt"), wanted={"phase"})
    (tmp_path / "runs").mkdir()
    (tmp_path / "runs" / "a.json").write_text('{"method": "m", "seed": 0, "headline": "prauc", "point": {"prauc": 0.5}, "bootstrap": {"prauc": {"mean": 0.5, "lo": 0.4, "hi": 0.6, "std": 0.1}}}')
    (tmp_path / "runs" / "b.json").write_text('{"method": ')
    rows = tables.run_records(spark, str(tmp_path / "runs")).collect()
    assert [(r["method"], r["value"], r["lo"]) for r in rows] == [("m", 0.5, 0.4)]
    preds = spark.createDataFrame([("t", "p", "m", 0, "N1", "test", 1.0, 0.3)], "task string, phase string, method string, seed int, nct_id string, split string, y_true double, y_proba double")
    tables.write_predictions(preds, str(tmp_path / "p"))
    tables.write_predictions(preds.withColumn("seed", F.lit(1)), str(tmp_path / "p"))
    assert tables.predictions(spark, str(tmp_path / "p"), "test").count() == 2


def test_incremental_leaderboard(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    paths = [str(tmp_path / n) for n in ("store", "out", "state")]
    for k, (method, value) in enumerate([("a", 0.4), ("b", 0.6)]):
        (source / f"{k}.json").write_text(f'{{"method": "{method}", "cell": "c", "seed": 0, "prauc": {value}}}')
        incremental(spark, str(source), *paths).awaitTermination()
    rows = latest(spark, paths[1]).orderBy("place").collect()
    assert [(r["method"], r["mean"]) for r in rows] == [("b", 0.6), ("a", 0.4)]
