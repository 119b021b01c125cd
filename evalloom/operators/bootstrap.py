"""Resampling inference on hash draws: the same draws on any partitioning, weights instead of copied rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.functions.scalars import hash_draw
from evalloom.operators.ranking import ranking_metrics, score_edges
from evalloom.operators.splits import hash_rank


def numbered(df: DataFrame, unit: str) -> DataFrame:
    """(unit, k): the distinct units numbered from 0 in the order of their hashes, without one task for all of them."""
    return hash_rank(df.select(unit).distinct(), [], "unit", unit).select(unit, (F.col("_rank") - 1).cast("bigint").alias("k"))


def draw_weights(df: DataFrame, unit: str, draws: int, seed: str) -> DataFrame:
    """(draw, unit, w): how often each unit was drawn, n units with replacement in each draw."""
    units = numbered(df, unit)
    total = units.agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    slots = units.crossJoin(F.broadcast(total)).select("n", F.col("k").alias("slot")).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    drawn = slots.select("draw", hash_draw(seed, F.col("draw"), F.col("slot"), n=F.col("n")).alias("k")).groupBy("draw", "k").agg(F.count(F.lit(1)).alias("w"))
    return drawn.join(units, "k").select("draw", unit, "w")


def resampled(df: DataFrame, unit: str, score: str, label: str, draws: int, seed: str, by: list[str] | None = None) -> DataFrame:
    """(by, draw, ap, auroc), null for draws of one class.

    Rows are counted by (unit, score, label) before the draws multiply them; a draw is summed in the sections of the undrawn scores.
    """
    by = by or []
    small = df.groupBy(*by, unit, score, label).agg(F.count(F.lit(1)).alias("c"))
    weighted = small.join(draw_weights(df, unit, draws, seed), unit)
    found = ranking_metrics(weighted, [*by, "draw"], score, label, F.col("w") * F.col("c"), edges=score_edges(df, by, score))
    return found.withColumn("ap", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("ap")))


def interval(values: DataFrame, column: str, level: float = 0.95) -> DataFrame:
    """(mean, lo, hi, std, used, requested) over the draws where the value is defined."""
    tail = (1 - level) / 2
    return values.agg(
        F.avg(column).alias("mean"),
        F.percentile(column, F.lit(tail)).alias("lo"),
        F.percentile(column, F.lit(1 - tail)).alias("hi"),
        F.stddev_pop(column).alias("std"),
        F.count(column).alias("used"),
        F.count(F.lit(1)).alias("requested"),
    )


def with_point(df: DataFrame, unit: str, score: str, label: str, draws: int, seed: str, metric: str = "ap", level: float = 0.95) -> DataFrame:
    """(point, mean, lo, hi, std, used, requested): the metric of the rows as they are beside its interval over drawn units."""
    point = ranking_metrics(df, [], score, label).select(F.col(metric).alias("point"))
    return interval(resampled(df, unit, score, label, draws, seed), metric, level).crossJoin(F.broadcast(point)).select("point", "mean", "lo", "hi", "std", "used", "requested")  # one row


def share_of_gain(df: DataFrame, unit: str, base: str, part: str, full: str, label: str, draws: int, seed: str, level: float = 0.95) -> DataFrame:
    """One row: the share (part - base) / (full - base) of three scores' AP, taken in each draw, with its interval.

    mean_base, mean_part and mean_full are over the draws of both classes; draws in which full and base are equal have no share.
    """
    tail, names = (1 - level) / 2, {"base": base, "part": part, "full": full}
    each = F.array(*[F.struct(F.lit(n).alias("arm"), F.col(s).cast("double").alias("_s")) for n, s in names.items()])
    arms = df.select(unit, F.col(label).alias("_y"), F.explode(each).alias("e")).select(unit, "_y", "e.arm", "e._s")
    found = resampled(arms, unit, "_s", "_y", draws, seed, ["arm"])
    wide = found.groupBy("draw").agg(*[F.max(F.when(F.col("arm") == n, F.col("ap"))).alias(n) for n in names])
    share = F.try_divide(F.col("part") - F.col("base"), F.nullif(F.col("full") - F.col("base"), F.lit(0.0)))
    made = wide.withColumn("share", share).agg(*[F.avg(n).alias(f"mean_{n}") for n in names], F.avg("share").alias("share"), F.percentile("share", F.lit(tail)).alias("lo"), F.percentile("share", F.lit(1 - tail)).alias("hi"), F.count("share").alias("used"))
    sizes = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(unit).alias("n_clusters"))
    return made.withColumn("width", F.col("hi") - F.col("lo")).crossJoin(F.broadcast(sizes))  # one row


def paired(df: DataFrame, unit: str, a: str, b: str, label: str, draws: int, seed: str, metric: str = "ap") -> DataFrame:
    """(draw, a, b, delta): both scores on the same draws, which are joined with the rows once."""
    arms = df.select(unit, F.col(label).alias("_y"), F.explode(F.array(*[F.struct(F.lit(k).alias("arm"), F.col(s).cast("double").alias("_s")) for k, s in enumerate((a, b))])).alias("e")).select(unit, "_y", "e.arm", "e._s")
    found = resampled(arms, unit, "_s", "_y", draws, seed, ["arm"])
    pick = lambda k: F.max(F.when(F.col("arm") == k, F.col(metric)))
    return found.groupBy("draw").agg(pick(0).alias("a"), pick(1).alias("b")).withColumn("delta", F.col("a") - F.col("b"))


def two_sample(first: DataFrame, second: DataFrame, unit: str, score: str, label: str, draws: int, seeds: tuple[str, str], metric: str = "ap") -> DataFrame:
    """(draw, a, b, delta) of two disjoint pools, drawn on their own."""
    left = resampled(first, unit, score, label, draws, seeds[0]).select("draw", F.col(metric).alias("a"))
    right = resampled(second, unit, score, label, draws, seeds[1]).select("draw", F.col(metric).alias("b"))
    return left.join(right, "draw").withColumn("delta", F.col("a") - F.col("b"))


def slope_draws(points: DataFrame, key: str, x: str, y: str, draws: int, seed: str) -> DataFrame:
    """(draw, slope): least squares over points drawn with replacement; 0 where x doesn't vary."""
    w = points.join(draw_weights(points, key, draws, seed), key)
    sums = w.groupBy("draw").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col(x)).alias("sx"), F.sum(F.col("w") * F.col(y)).alias("sy"), F.sum(F.col("w") * F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col("w") * F.col(x) * F.col(y)).alias("sxy"))
    over = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    return sums.select("draw", F.when(F.abs(over) < 1e-9, 0.0).otherwise((F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / over).alias("slope"))


def permutation_p(observed: Column, null: Column) -> Column:
    """(k + 1) / (n + 1) with k null values at or above the observed one."""
    return (F.sum((null >= observed).cast("int")) + 1) / (F.count(null) + 1)


def macro_paired(df: DataFrame, cell: str, unit: str, a: str, b: str, label: str, draws: int, seed: str, metric: str = "ap") -> DataFrame:
    """(draw, delta): the mean over cells of the paired difference; each cell is drawn by itself, both scores on the same draws."""
    arms = df.select(cell, unit, F.col(label).alias("_y"), F.explode(F.array(*[F.struct(F.lit(k).alias("arm"), F.col(s).cast("double").alias("_s")) for k, s in enumerate((a, b))])).alias("e")).select(cell, F.concat_ws("|", cell, unit).alias("_u"), "_y", "e.arm", "e._s")
    units = hash_rank(arms.select(cell, "_u").distinct(), [cell], "unit", "_u")
    sizes = units.groupBy(cell).agg(F.count(F.lit(1)).cast("bigint").alias("_n"))
    slots = units.join(sizes, cell).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    drawn = slots.select(cell, "draw", (hash_draw(seed, F.col(cell), F.col("draw"), F.col("_rank"), n=F.col("_n")) + 1).alias("_rank")).groupBy(cell, "draw", "_rank").agg(F.count(F.lit(1)).alias("w"))
    weights = drawn.join(units, [cell, "_rank"]).select("draw", "_u", "w")
    small = arms.groupBy(cell, "arm", "_u", "_s", "_y").agg(F.count(F.lit(1)).alias("c")).join(weights, "_u")
    found = ranking_metrics(small, [cell, "arm", "draw"], "_s", "_y", F.col("w") * F.col("c"), edges=score_edges(arms, [cell, "arm"], "_s"))
    value = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col(metric))
    pick = lambda k: F.max(F.when(F.col("arm") == k, value))
    cells = found.groupBy(cell, "draw").agg((pick(0) - pick(1)).alias("d"))
    return cells.groupBy("draw").agg(F.avg("d").alias("delta"))


def mean_draws(df: DataFrame, unit: str, value: str, draws: int, seed: str) -> DataFrame:
    """(draw, mean) of a column over units drawn with replacement."""
    w = df.select(unit, value).join(draw_weights(df, unit, draws, seed), unit)
    return w.groupBy("draw").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias("mean"))


def permuted_labels(df: DataFrame, key: str, label: str, draws: int, seed: str) -> DataFrame:
    """(draw, key, label): in each draw the labels are dealt again by the order of hashes, every row's label once."""
    each = df.select(key, label).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    placed = hash_rank(each.withColumn("_dk", F.concat_ws("|", "draw", key)), ["draw"], seed, "_dk").select("draw", key, "_rank")
    source = hash_rank(df.select(F.col(key).alias("_from"), F.col(label).alias("permuted")), [], "unit", "_from").select("permuted", "_rank")
    return placed.join(source, "_rank").select("draw", key, "permuted")
