"""Ranking and threshold metrics as relational algebra, ties grouped first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.storage import cut


def tie_groups(df: DataFrame, by: list[str], score: str, label: str, weight: Column | None = None) -> DataFrame:
    """(by, score, pos, neg): weight of positives and negatives at each score."""
    w = F.lit(1) if weight is None else weight
    return df.groupBy(*by, F.col(score).alias("score")).agg(F.sum((w * F.col(label)).cast("double")).alias("pos"), F.sum((w * (1 - F.col(label))).cast("double")).alias("neg"))


def score_edges(df: DataFrame, by: list[str], score: str, sections: int = 64) -> DataFrame:
    """(by, _edges): quantiles that cut each key's scores into about equal sections.

    Approximate quantiles of many scores depend on the order in which tasks' parts arrive. They are written once, so that rows and
    the totals of sections, which both are cut at them, have the same.
    """
    at = [k / sections for k in range(1, sections)]
    return cut(df.groupBy(*by).agg(F.percentile_approx(F.col(score).cast("double"), at, 1000).alias("_edges")), "edges")


def running(groups: DataFrame, by: list[str], sections: int = 64, edges: DataFrame | None = None) -> DataFrame:
    """groups (by, score, pos, neg) with tp and fp, running totals by falling score.

    Each key's scores are cut at quantiles first: a section is summed by itself and starts from the totals of those above
    it, so no task sorts all scores of a key. `edges`, by some of the keys, saves finding them. With sections = 0 a key is
    one task, for many keys with few scores each.
    """
    if not sections:
        down = Window.partitionBy(*by).orderBy(F.desc("score"))
        return groups.withColumn("tp", F.sum("pos").over(down)).withColumn("fp", F.sum("neg").over(down))
    edges = score_edges(groups, by, "score", sections) if edges is None else edges
    keys = [c for c in edges.columns if c != "_edges"]
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_e{k}")) for k, c in enumerate(keys)], F.lit(True))
    named = edges.select(*[F.col(c).alias(f"_e{k}") for k, c in enumerate(keys)], "_edges")
    placed = groups.join(named if keys else F.broadcast(named), same)  # one row without keys
    placed = placed.withColumn("_part", F.size(F.filter("_edges", lambda e: e < F.col("score")))).select(*groups.columns, "_part")
    above = Window.partitionBy(*by).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)  # a row a section
    totals = placed.groupBy(*by, "_part").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    starts = totals.select(*by, "_part", F.sum("_p").over(above).alias("pos"), F.sum("_n").over(above).alias("neg"), F.lit(True).alias("_start"))
    rows = placed.withColumn("_start", F.lit(False)).unionByName(starts.where("pos is not null"), allowMissingColumns=True)
    down = Window.partitionBy(*by, "_part").orderBy(F.desc("_start"), F.desc("score"))
    own = rows.withColumn("tp", F.sum("pos").over(down)).withColumn("fp", F.sum("neg").over(down))
    return own.where(~F.col("_start")).select(*groups.columns, "tp", "fp")


def ranking_metrics(df: DataFrame, by: list[str], score: str, label: str, weight: Column | None = None, sections: int = 64, edges: DataFrame | None = None) -> DataFrame:
    """(by, ap, auroc, n_pos, n_neg): step average precision and tie-aware AUROC.

    Of one class alone AP is 1 (no negatives) or 0 (no positives) and AUROC is null. Give sections = 0 where there are many
    keys with few scores each.
    """
    walked = running(tie_groups(df, by, score, label, weight), by, sections, edges)
    sums = walked.groupBy(*by).agg(
        F.sum(F.try_divide(F.col("pos") * F.col("tp"), F.col("tp") + F.col("fp"))).alias("s"),
        F.sum(F.col("pos") * (F.col("neg") / 2 - F.col("fp"))).alias("u"),
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
    )
    ap = F.when(F.col("n_pos") > 0, F.try_divide("s", F.col("n_pos"))).when(F.col("n_neg") > 0, 0.0)
    auroc = F.try_divide(F.col("u") + F.col("n_pos") * F.col("n_neg"), F.col("n_pos") * F.col("n_neg"))
    return sums.select(*by, ap.alias("ap"), auroc.alias("auroc"), F.col("n_pos").cast("bigint").alias("n_pos"), F.col("n_neg").cast("bigint").alias("n_neg"))


def threshold_metrics(df: DataFrame, by: list[str], predicted: Column, label: str) -> DataFrame:
    """accuracy, precision, recall, F1 (0 where undefined), specificity and balanced accuracy (null where undefined)."""
    y = F.col(label)
    c = df.groupBy(*by).agg(F.sum(predicted * y).alias("tp"), F.sum(predicted * (1 - y)).alias("fp"), F.sum((1 - predicted) * y).alias("fn"), F.sum((1 - predicted) * (1 - y)).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return c.select(
        *by,
        ((tp + tn) / (tp + fp + fn + tn)).alias("accuracy"),
        zero(tp, tp + fp).alias("precision"),
        zero(tp, tp + fn).alias("recall"),
        zero(2 * tp, 2 * tp + fp + fn).alias("f1"),
        F.try_divide(tn, tn + fp).alias("specificity"),
        ((F.try_divide(tp, tp + fn) + F.try_divide(tn, tn + fp)) / 2).alias("balanced_accuracy"),
    )


def rank_percentile(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """df with pct, the average rank from 0 to 1. Without `by` all rows are one ranking. Distinct values are ranked in sections."""
    groups = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("score")).agg(F.count(F.lit(1)).cast("double").alias("pos")).withColumn("neg", F.lit(0.0))
    sizes = groups.groupBy(*by).agg(F.sum("pos").alias("_all"))
    walked = running(groups, by)
    walked = walked.join(sizes, by) if by else walked.crossJoin(F.broadcast(sizes))  # one row
    ranks = walked.select(*by, F.col("score").alias(value), ((F.col("_all") - F.col("tp") + (F.col("pos") - 1) / 2) / F.greatest(F.col("_all") - 1, F.lit(1.0))).alias("pct"))
    return df.join(ranks, [*by, value])


def blend_curve(df: DataFrame, a: str, b: str, label: str, steps: int = 100, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, w, ap) of w * a + (1 - w) * b for w = 0, 1/steps, ..., 1. Equal rows are counted before the weights multiply them."""
    each = df.groupBy(*by, a, b, label).agg(F.count(F.lit(1)).alias("_c")).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    blended = each.withColumn("blend", F.round((F.col("step") * F.col(a) + (steps - F.col("step")) * F.col(b)) / steps, 9))
    return ranking_metrics(blended, [*by, "step"], "blend", label, F.col("_c")).select(*by, (F.col("step") / steps).alias("w"), "ap")


def best_weight(valid: DataFrame, test: DataFrame, a: str, b: str, label: str, steps: int = 100, slack: float = 0.001) -> DataFrame:
    """(best_w, valid_ap, width, test_ap): the smallest weight with the highest AP on `valid`, the span of weights within `slack`
    of it, and its AP on `test`."""
    curve = blend_curve(valid, a, b, label, steps).select("w", F.round("ap", 9).alias("ap"))
    top = curve.agg(F.max("ap").alias("valid_ap"))
    near = F.when(F.col("ap") >= F.col("valid_ap") - slack, F.col("w"))
    chosen = curve.crossJoin(F.broadcast(top)).groupBy("valid_ap").agg(F.min(F.when(F.col("ap") == F.col("valid_ap"), F.col("w"))).alias("best_w"), (F.max(near) - F.min(near)).alias("width"))
    tested = blend_curve(test, a, b, label, steps).select("w", F.col("ap").alias("test_ap"))
    return chosen.join(tested, F.col("best_w") == F.col("w")).select("best_w", "valid_ap", "width", "test_ap")


def combiner_lifts(valid: DataFrame, test: DataFrame, by: tuple[str, ...], a: str, b: str, label: str, steps: int = 100, slack: float = 0.001) -> DataFrame:
    """(by, source, fixed, tuned, oracle, width, captured): what blending adds to the better source's AP on `test`.

    fixed is at equal weights, tuned at the smallest weight that is best on `valid`, oracle at the best weight on `test`. width is
    the span of weights within `slack` of the best on `valid`, captured the percentage of tuned that fixed gives, null where tuned
    is 0. `steps` is even. Groups without positives on either side are left out.
    """
    curve = lambda df, name: blend_curve(df, a, b, label, steps, by).select(*by, "w", F.round("ap", 9).alias(name)).where(F.col(name).isNotNull())
    both = curve(valid, "v").join(curve(test, "t"), [*by, "w"])
    at = lambda *ws: F.max(F.when(F.col("w").isin(*ws), F.col("t")))
    top = F.max(F.struct("v", (-F.col("w")).alias("less"), "t"))
    found = both.groupBy(*by).agg(at(0.0, 1.0).alias("source"), at(0.5).alias("half"), F.max("t").alias("most"), top.alias("top"), F.collect_list(F.struct("w", "v")).alias("points"))  # a point a step
    near = F.filter("points", lambda x: x["v"] >= F.col("top.v") - slack)["w"]
    lifts = found.select(*by, "source", (F.col("half") - F.col("source")).alias("fixed"), (F.col("top.t") - F.col("source")).alias("tuned"), (F.col("most") - F.col("source")).alias("oracle"), (F.array_max(near) - F.array_min(near)).alias("width"))
    return lifts.withColumn("captured", 100 * F.col("fixed") / F.nullif(F.round("tuned", 9), F.lit(0.0)))


def macro_ovr(df: DataFrame, klass: str, scores: list[str]) -> DataFrame:
    """Mean one-against-the-rest AUROC and AP over the classes 0, 1, ... that the score columns stand for.

    AP leaves out classes that no row has; AUROC is null if there is one.
    """
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.col(s).alias("score")) for k, s in enumerate(scores)])
    long = df.select(F.col(klass).alias("klass"), F.explode(pairs).alias("e")).select("e.k", "e.score", (F.col("klass") == F.col("e.k")).cast("int").alias("y"))
    each = ranking_metrics(long, ["k"], "score", "y")
    there = F.col("n_pos") > 0
    return each.agg(F.avg(F.when(there, F.col("ap"))).alias("macro_ap"), F.when(F.bool_and(there), F.avg("auroc")).alias("macro_auroc"), F.count(F.when(there, 1)).alias("n_classes"))


def macro_labels(df: DataFrame, klass: str, scores: list[str]) -> DataFrame:
    """(accuracy, macro_f1): the predicted class is the first of the highest score; a class without rows has F1 0."""
    values = F.array(*scores)
    said = df.select(F.col(klass).alias("klass"), (F.array_position(values, F.array_max(values)) - 1).cast("int").alias("said"))
    pairs = F.explode(F.array(*[F.lit(k) for k in range(len(scores))])).alias("k")
    tp, either = F.sum(((F.col("klass") == F.col("k")) & (F.col("said") == F.col("k"))).cast("long")), F.sum((F.col("klass") == F.col("k")).cast("long") + (F.col("said") == F.col("k")).cast("long"))
    each = said.select("klass", "said", pairs).groupBy("k").agg(tp.alias("tp"), F.coalesce(F.try_divide(2 * tp, either), F.lit(0.0)).alias("f1"), F.count(F.lit(1)).alias("n"))
    return each.agg((F.sum("tp") / F.max("n")).alias("accuracy"), F.avg("f1").alias("macro_f1"))
