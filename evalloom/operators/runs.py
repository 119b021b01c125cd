"""Run records: coverage, leaderboards over shared cells, selection, noise floors, gains, costs and resuming a grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def coverage(runs: DataFrame, method: str, phase: str, cell: str) -> DataFrame:
    """(method, phase, coverage): "done/total" cells."""
    total = runs.groupBy(phase).agg(F.countDistinct(cell).alias("_total"))
    done = runs.groupBy(method, phase).agg(F.countDistinct(cell).alias("_done"))
    return done.join(total, phase).select(method, phase, F.concat_ws("/", "_done", "_total").alias("coverage"))


def shared_cells(runs: DataFrame, method: str, cell: str) -> DataFrame:
    """Cells that every method has."""
    methods = runs.agg(F.countDistinct(method).alias("_m"))
    return runs.groupBy(cell).agg(F.countDistinct(method).alias("_n")).crossJoin(F.broadcast(methods)).where("_n = _m").select(cell)


def leaderboard(runs: DataFrame, method: str, cell: str, metric: str) -> DataFrame:
    """(method, mean, place): seeds are averaged first, then the cells that every method has."""
    cells = runs.groupBy(method, cell).agg(F.avg(metric).alias("_x")).join(shared_cells(runs.where(F.col(metric).isNotNull()), method, cell), cell, "left_semi")
    means = cells.groupBy(method).agg(F.avg("_x").alias("mean"), F.count(F.lit(1)).alias("n_cells"))
    return means.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.round("mean", 9)), method)))


def complete_cells(runs: DataFrame, method: str, cell: str, seed: str, wanted: int) -> DataFrame:
    """(method, complete): whether every cell of a method has the wanted number of seeds."""
    seeds = runs.groupBy(method, cell).agg(F.countDistinct(seed).alias("_s"))
    return seeds.groupBy(method).agg(F.bool_and(F.col("_s") >= wanted).alias("complete"))


def best_on_valid(runs: DataFrame, cell: str, choice: str, valid: str, test: str) -> DataFrame:
    """(cell, choice, valid, test): chosen by the validation value; ties go to the smallest choice."""
    w = Window.partitionBy(cell).orderBy(F.desc(valid), choice)
    return runs.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(cell, choice, valid, test)


def noise_floor(runs: DataFrame, cell: str, method: str, metric: str, half_width: str) -> DataFrame:
    """(cell, floor): the larger of 1.96 pooled seed deviations and the mean interval half-width."""
    per = runs.groupBy(cell, method).agg(F.stddev_samp(metric).alias("_sd"), F.avg(half_width).alias("_hw"))
    return per.groupBy(cell).agg(F.greatest(1.96 * F.sqrt(F.avg(F.col("_sd") * F.col("_sd"))), F.avg("_hw")).alias("floor"))


def paired_gain(before: DataFrame, after: DataFrame, keys: list[str], metric: str, by: str) -> DataFrame:
    """(by, gain, n): mean difference over keys that both have."""
    pre = before.select(*keys, F.col(metric).alias("_pre"))
    return after.join(pre, keys).groupBy(by).agg(F.avg(F.col(metric) - F.col("_pre")).alias("gain"), F.count(F.lit(1)).alias("n"))


def gain_by_cell(before: DataFrame, after: DataFrame, cell: list[str], method: str, seed: str, metric: str, floors: DataFrame) -> DataFrame:
    """(cell, gain, n_methods, n_pairs, exceeds): seeds that both have are averaged by method, then methods by cell.

    floors is (cell, floor); exceeds says whether the gain is beyond it in either direction, null for a cell without a floor.
    Runs without a value aren't paired.
    """
    pre = before.select(*cell, method, seed, F.col(metric).alias("_pre"))
    gain = F.col(metric) - F.col("_pre")
    methods = after.join(pre, [*cell, method, seed]).where(gain.isNotNull()).groupBy(*cell, method).agg(F.avg(gain).alias("_g"), F.count(F.lit(1)).alias("_n"))
    cells = methods.groupBy(*cell).agg(F.avg("_g").alias("gain"), F.count(F.lit(1)).alias("n_methods"), F.sum("_n").alias("n_pairs"))
    return cells.join(floors.select(*cell, "floor"), cell, "left").withColumn("exceeds", F.abs("gain") > F.col("floor")).drop("floor")


def scored_by_all(predictions: DataFrame, keys: list[str], method: str, score: str, methods: list[str]) -> DataFrame:
    """keys and a column of scores for each of `methods`, for the rows that all of them scored; a repeated score counts with its mean."""
    wide = predictions.where(F.col(method).isin(methods)).groupBy(*keys).pivot(method, methods).agg(F.avg(score))
    return wide.dropna(subset=methods)


def gap_closure(cells: DataFrame, base: str, better: str, top: str) -> DataFrame:
    """The median share of the gap from base to top that `better` closes; cells without a gap are left out."""
    ratio = F.try_divide(F.col(better) - F.col(base), F.nullif(F.col(top) - F.col(base), F.lit(0.0)))
    return cells.select(ratio.alias("r")).agg(F.percentile("r", 0.5).alias("median_closure"), F.count("r").alias("n"))


def cost(calls: DataFrame, prices: DataFrame, model: str, by: str) -> DataFrame:
    """(by, tokens_in, tokens_out, usd) at prices for a million tokens; a call without a price is an error."""
    joined = calls.join(prices, model, "left")
    priced = joined.withColumn("_p", F.coalesce(F.col("usd_in"), F.raise_error(F.concat(F.lit("no price for "), F.col(model))).cast("double")))
    usd = F.sum(F.col("tokens_in") * F.col("_p") + F.col("tokens_out") * F.col("usd_out")) / 1e6
    return priced.groupBy(by).agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), usd.alias("usd"))


def to_run(grid: DataFrame, runs: DataFrame, keys: list[str], config: str) -> DataFrame:
    """Grid rows without a run; a run of another configuration is an error, one without a configuration is accepted."""
    known = runs.select(*keys, F.col(config).alias("_old"), F.lit(True).alias("_ran"))
    joined = grid.join(known, keys, "left")
    clash = F.col("_old").isNotNull() & (F.col("_old") != F.col(config))
    error = F.raise_error(F.lit("a run of this cell has another configuration")).cast("boolean")
    return joined.where(F.when(clash, error).otherwise(F.col("_ran").isNull())).select(*grid.columns)


def tier_cost(calls: DataFrame, prices: DataFrame, model: str, tier: str) -> DataFrame:
    """(model, usd, sync_usd, mixed): cost at each call's own tier, at the full price, and whether tiers were mixed. `batch` is what share
    of the full price the tier "batch" costs; a call without a price is an error."""
    joined = calls.join(prices, model, "left")
    full = F.col("tokens_in") * F.coalesce(F.col("usd_in"), F.raise_error(F.concat(F.lit("no price for "), F.col(model))).cast("double")) + F.col("tokens_out") * F.col("usd_out")
    own = full * F.when(F.col(tier) == "batch", F.col("batch")).otherwise(1.0)
    return joined.groupBy(model).agg((F.sum(own) / 1e6).alias("usd"), (F.sum(full) / 1e6).alias("sync_usd"), (F.countDistinct(tier) > 1).alias("mixed"))


def family_rollup(gains: DataFrame, family: str, gain: str, delta: float) -> DataFrame:
    """(family, mean, n, exceeds, one_sign): mean gain, cells beyond +-delta, and whether all gains have one sign."""
    sign = F.signum(F.col(gain))
    return gains.groupBy(family).agg(F.avg(gain).alias("mean"), F.count(F.lit(1)).alias("n"), F.sum((F.abs(gain) > delta).cast("long")).alias("exceeds"), (F.min(sign) == F.max(sign)).alias("one_sign"))


def markdown(df: DataFrame, columns: list[str]) -> DataFrame:
    """(line): a Markdown table of a small frame, head first, in order of the first column."""
    head = df.sparkSession.createDataFrame([(0, None, "| " + " | ".join(columns) + " |"), (1, None, "|" + "-|" * len(columns))], "at int, first string, line string")
    cells = F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    rows = df.select(F.lit(2).alias("at"), F.col(columns[0]).cast("string").alias("first"), F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"))
    return head.unionByName(rows).orderBy("at", "first").select("line")


def class_shares(df: DataFrame, klass: str) -> DataFrame:
    """(class, share) of the classes that rows have; their mean is the chance level of macro AP."""
    counts = df.groupBy(klass).agg(F.count(F.lit(1)).alias("_n"))
    return counts.select(klass, (F.col("_n") / F.sum("_n").over(Window.partitionBy(F.lit(0)))).alias("share"))  # a row a class


def keyed_pairs(first: DataFrame, second: DataFrame, keys: list[str], suffixes: tuple[str, str]) -> DataFrame:
    """Rows of both frames that agree in all keys; their other columns carry a suffix for the frame they come from."""
    a, b = (df.withColumnsRenamed({c: f"{c}_{s}" for c in df.columns if c not in keys}) for df, s in zip((first, second), suffixes, strict=True))
    return a.join(b, keys)
