"""Decision tables: rules as data, met with results by ranges; the first rule whose conditions all hold gives the verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULE = "rule int, verdict string, name string, low double, high double"

#: The verdicts, in the order in which they are tried. A rule is (verdict, {number: (above, up to)}); none is open.
RECALL = [
    ("NO_RECALL_FINDING_CALIBRATION_ARTIFACT", {"own_lo": (None, 0.0)}),
    ("OUTCOME_RECALL_DEMONSTRATED", {"difference_lo": (0.0, None)}),
    ("INCONCLUSIVE", {}),
]
MASKED_READING = [
    ("MEMORISATION_SIGNATURE", {"own_b_lo": (0.0, None), "own_a_lo": (None, 0.0)}),
    ("QUARANTINE_LIFTED_DISEASE_UNINFORMATIVE", {"reference_a_lo": (None, 0.0), "own_a_lo": (None, 0.0)}),
    ("NOT_SEPARABLE_ON_ARM_A_ALONE", {"reference_a_lo": (0.0, None), "own_a_lo": (None, 0.0)}),
    ("NORMAL_BEHAVIOUR", {}),
]


def branch_rules(shrink_above: float) -> list[tuple[str, dict]]:
    """Rules on title_margin (the threshold less p, above 0 where significant), rate_margin (real less shuffled) and outcome_rate."""
    title = {"title_margin": (0.0, None), "rate_margin": (0.0, None)}
    return [("SHRINK_TO_UNRECOGNIZED_STRATUM", title | {"outcome_rate": (shrink_above, None)}), ("STRATIFY", title), ("PROCEED_AS_DESIGNED", {})]


def rule_table(spark: SparkSession, rules: list[tuple[str, dict]]) -> DataFrame:
    """(rule, verdict, name, low, high): a row a condition, low < value <= high; a rule without conditions has one row without a name."""
    rows = [(k, verdict, name, low, high) for k, (verdict, conditions) in enumerate(rules) for name, (low, high) in (conditions or {None: (None, None)}).items()]
    return spark.createDataFrame(rows, RULE)


def decide(results: DataFrame, key: str, rules: DataFrame) -> DataFrame:
    """(key, rule, verdict). Numbers are columns of results; a null or missing one meets no condition. A result that no rule meets is an error."""
    numbers = [c for c in results.columns if c != key]
    long = results.select(key, *[F.col(c).cast("double").alias(c) for c in numbers]).unpivot([key], numbers, "name", "value").where("value is not null and not isnan(value)")
    wanted = rules.where("name is not null").groupBy("rule", "verdict").agg(F.count(F.lit(1)).alias("_wanted"))
    inside = (F.col("low").isNull() | (F.col("value") > F.col("low"))) & (F.col("high").isNull() | (F.col("value") <= F.col("high")))
    met = long.join(rules.drop("verdict"), "name").where(inside).groupBy(key, "rule").agg(F.count(F.lit(1)).alias("_met"))
    whole = met.join(wanted, "rule").where("_met = _wanted").groupBy(key).agg(F.min(F.struct("rule", "verdict")).alias("_first"))
    always = rules.where("name is null").agg(F.min(F.struct("rule", "verdict")).alias("_always"))
    both = results.select(key).join(whole, key, "left").crossJoin(F.broadcast(always))  # one row
    first = F.least("_first", "_always")
    fine = F.when(first.isNull(), F.raise_error(F.concat(F.lit("no rule for "), F.col(key).cast("string")))).otherwise(first["verdict"])
    return both.select(key, first["rule"].alias("rule"), fine.cast("string").alias("verdict"))
