"""Sections of scores are cut at quantiles that are found once."""

from pyspark.sql import functions as F

from evalloom.operators import ranking


def test_edges_are_found_once(spark):
    """Rows and totals of sections asked for quantiles by themselves; parts that arrive in another order give other ones."""
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 3001).cast("double").alias("s"), (F.col("id") % 2).alias("y"))
    for by in (["g"], []):
        found = ranking.ranking_metrics(df, by, "s", "y", sections=8)
        assert "percentile_approx" not in found._jdf.queryExecution().executedPlan().toString()
        assert sum(r["n_pos"] for r in found.collect()) == 1500
