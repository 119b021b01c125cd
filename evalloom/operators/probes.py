"""Probes of a model or a design: permutation importance, detectable effects, out-of-fold scores, tuning and encodings."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.operators.bootstrap import draw_weights
from evalloom.operators.features import MISSING
from evalloom.operators.ranking import ranking_metrics
from evalloom.operators.splits import hash_rank


def permutation_importance(df: DataFrame, key: str, features: list[str], label: str, score: Callable[[dict[str, Column]], Column], repeats: int, seed: str) -> DataFrame:
    """(feature, importance, std): the mean drop of AP when a feature's values are dealt again, over `repeats` dealings.

    All features and repeats are one plan: every dealing is a rank of the rows by a hash of its own, met with the rows in the order
    of one other hash. score is an expression over columns, given by feature.
    """
    rows = df.select(key, label, *features)
    donors = hash_rank(rows.select(F.col(key).alias("_from"), F.struct(*features).alias("_donor")), [], "unit", "_from").select("_rank", "_donor")
    each = rows.withColumn("feature", F.explode(F.array(*map(F.lit, features)))).withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    placed = hash_rank(each.withColumn("_dealt", F.concat_ws("|", "feature", "repeat", key)), ["feature", "repeat"], seed, "_dealt")
    mixed = {f: F.when(F.col("feature") == f, F.col("_donor")[f]).otherwise(F.col(f)) for f in features}
    dealt = placed.join(donors, "_rank").select("feature", "repeat", label, score(mixed).alias("_s"))
    found = ranking_metrics(dealt, ["feature", "repeat"], "_s", label)
    base = ranking_metrics(rows.select(label, score({f: F.col(f) for f in features}).alias("_s")), [], "_s", label).select(F.col("ap").alias("_base"))
    drop = F.col("_base") - F.col("ap")
    return found.crossJoin(F.broadcast(base)).groupBy("feature").agg(F.avg(drop).alias("importance"), F.stddev_pop(drop).alias("std"))  # one row


def top_features(importance: DataFrame, k: int, negligible: float = 0.001) -> DataFrame:
    """(place, feature, importance, n_negligible): the k most important features, ties by name, and how many of all are below `negligible`."""
    small = importance.agg(F.sum((F.col("importance") < negligible).cast("long")).alias("n_negligible"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc(F.round("importance", 9)), "feature")  # a row a feature
    ranked = importance.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return ranked.crossJoin(F.broadcast(small)).select("place", "feature", "importance", "n_negligible")


def power_probe(a: DataFrame, b: DataFrame, key: str, unit: str, label: str, fractions: list[float], draws: int, seeds: tuple[str, str], level: float = 0.95) -> DataFrame:
    """(fraction, lo, hi, used, clears_zero, smallest): which injected drop two disjoint pools can show.

    Both pools are scored perfectly, then a fraction of a's rows, the first in hash order, gets 0.5, which counts as positive. The
    interval is of a's balanced accuracy less b's over draws of units; fractions share the draws, since those changed by a smaller
    one are among those of a larger one. smallest marks the first fraction whose interval lies below zero.
    """
    tail = (1 - level) / 2
    placed = hash_rank(a.select(key, unit, label), [], f"{seeds[0]}-flip", key)
    total = a.agg(F.count(F.lit(1)).alias("_n"))
    y = F.col(label)
    missed = [F.sum(((y == 0) & (F.col("_rank") <= F.round(F.lit(f) * F.col("_n")))).cast("long")).alias(f"m{k}") for k, f in enumerate(fractions)]
    units = placed.crossJoin(F.broadcast(total)).groupBy(unit).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"), *missed)  # one row
    w = F.col("w")
    sums = units.join(draw_weights(a, unit, draws, seeds[0]), unit).groupBy("draw").agg(F.sum(w * F.col("pos")).alias("pos"), F.sum(w * F.col("neg")).alias("neg"), *[F.sum(w * F.col(f"m{k}")).alias(f"m{k}") for k in range(len(fractions))])
    other = b.groupBy(unit).agg(F.sum(y).alias("p"), F.sum(1 - y).alias("n")).join(draw_weights(b, unit, draws, seeds[1]), unit).groupBy("draw").agg(F.sum(w * F.col("p")).alias("p"), F.sum(w * F.col("n")).alias("n"))
    both = sums.join(other, "draw")
    whole = (F.col("pos") > 0) & (F.col("neg") > 0) & (F.col("p") > 0) & (F.col("n") > 0)
    cases = F.array(*[F.struct(F.lit(f).alias("fraction"), F.when(whole, (1 - F.col(f"m{k}") / F.col("neg")) / 2 - F.lit(0.5)).alias("delta")) for k, f in enumerate(fractions)])
    ends = both.select(F.inline(cases)).groupBy("fraction").agg(F.percentile("delta", F.lit(tail)).alias("lo"), F.percentile("delta", F.lit(1 - tail)).alias("hi"), F.count("delta").alias("used"))
    clears = F.coalesce(F.col("hi") < 0, F.lit(False))
    first = F.min(F.when(clears, F.col("fraction"))).over(Window.partitionBy(F.lit(0)))  # a row a fraction
    return ends.select("fraction", "lo", "hi", "used", clears.alias("clears_zero"), F.coalesce(F.col("fraction") == first, F.lit(False)).alias("smallest"))


def stratified_folds(df: DataFrame, key: str, label: str, folds: int, seed: str) -> DataFrame:
    """df with _fold: rows of each label dealt in turn by hash order."""
    return hash_rank(df, [label], seed, key).withColumn("_fold", ((F.col("_rank") - 1) % folds).cast("int")).drop("_rank")


def out_of_fold(df: DataFrame, key: str, label: str, folds: int, seed: str, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """(key, label, fold, score): each row scored by a model of the other folds. fit gets the other folds and returns what scores a frame.

    There are at most as many folds as the smaller class has rows; a label of one value, or with one row, is an error.
    """
    counts = [r["count"] for r in df.groupBy(label).count().collect()]  # a row a class
    folds = min([folds, *counts])
    if len(counts) < 2 or folds < 2:
        raise ValueError("out-of-fold scores need two classes of two rows at least")
    dealt = stratified_folds(df, key, label, folds, seed)
    parts = [fit(dealt.where(F.col("_fold") != k))(dealt.where(F.col("_fold") == k)).select(key, label, F.col("_fold").alias("fold"), "score") for k in range(folds)]
    return reduce(DataFrame.unionByName, parts)


class AveragePrecision(Evaluator):
    """Step average precision of a model's probability of class 1, ties grouped."""

    def __init__(self, label: str = "y", probability: str = "probability"):
        super().__init__()
        self.label, self.probability = label, probability

    def _evaluate(self, dataset: DataFrame) -> float:
        rows = dataset.select(F.col(self.label).alias("y"), vector_to_array(self.probability)[1].alias("s"))
        return ranking_metrics(rows, [], "s", "y").first()["ap"]

    def isLargerBetter(self) -> bool:  # noqa: N802
        return True


def tuned(estimator, grid: list[dict], train: DataFrame, valid: DataFrame, evaluator: Evaluator, parallel: int = 4):
    """(model, choice, values): the estimator fitted with the params that score best on valid, the first among equals; fits run side by side."""

    def fitted(params: dict):
        model = estimator.copy(params).fit(train)
        return model, evaluator.evaluate(model.transform(valid))

    with ThreadPoolExecutor(min(parallel, len(grid))) as pool:
        found = list(pool.map(fitted, grid))
    best = max(range(len(grid)), key=lambda k: (found[k][1], -k))
    return found[best][0], grid[best], [v for _, v in found]


def encoding_collapse(train: DataFrame, test: DataFrame, columns: list[str], label: str, smoothing: float = 20.0) -> DataFrame:
    """(column, levels, rows_per_level, unseen, std_train, std_test): whether target means say more than the overall mean.

    levels are the training rows' with null as one; unseen is the share of test rows whose level training lacks; the deviations are
    of the encoded rows, unseen ones at the mean. All columns go through one aggregate by (column, level).
    """
    long = lambda df, y, part: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias("level")) for c in columns])).alias("e"), y.cast("double").alias("y"), F.lit(part).alias("part")).select("e.*", "y", "part")
    rows = long(train, F.col(label), 0).unionByName(long(test, F.lit(None), 1))
    each = rows.groupBy("column", "level").agg(F.sum((F.col("part") == 0).cast("long")).alias("n"), F.sum((F.col("part") == 1).cast("long")).alias("m"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("s"))
    own = Window.partitionBy("column")
    mean = F.sum("s").over(own) / F.sum("n").over(own)
    coded = each.withColumn("e", F.when(F.col("n") > 0, (F.col("s") + smoothing * mean) / (F.col("n") + smoothing)).otherwise(mean))
    spread = lambda w: F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.sum(F.col(w) * F.col("e") * F.col("e")), F.sum(w)) - F.pow(F.try_divide(F.sum(F.col(w) * F.col("e")), F.sum(w)), F.lit(2))))
    levels = F.sum((F.col("n") > 0).cast("long"))
    return coded.groupBy("column").agg(levels.alias("levels"), F.try_divide(F.sum("n"), levels).alias("rows_per_level"), F.try_divide(F.sum(F.when(F.col("n") == 0, F.col("m")).otherwise(0)), F.sum("m")).alias("unseen"), spread("n").alias("std_train"), spread("m").alias("std_test"))
