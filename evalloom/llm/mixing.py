"""Mixing sources by temperature: weights are token shares to a power, realised as budgeted block permutations.

The exponent is found by repeated section of [0, TOP]: the smallest that keeps every source's repetitions within a limit,
or the largest whose weights reach a target entropy. A source's documents hash to BLOCKS blocks; each epoch is a
permutation of the blocks, whole epochs are taken while the budget lasts and the last takes blocks in order while they
fit. Without a budget the total is the least that takes every source in whole once, so mixing only repeats documents.

Defined cases: a document counts as its words, at least 1. A null source is a source of its own and a null id hashes like
any value. Rows that repeat an id share a block. One source gets weight 1. An empty table gives an empty result; other
columns pass. Nothing but sources
and their blocks is ever joined with the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.llm.shared import cut, free_name

BLOCKS = 256
#: Sections of the exponent's interval in a round, and rounds: (1/64)**6 is below 2e-11.
SECTIONS, ROUNDS = 64, 6
TOP = 1.0
SEED = "mix"
WORD = r"[^\x20\x09-\x0D]+"


def number(text: Column) -> Column:
    """The first 32 bits of a text's MD5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def doc_tokens(text_col: str) -> Column:
    return F.greatest(F.lit(1), F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0))).cast("long")


def block_of(id_col: str, blocks: int) -> Column:
    key = F.concat(F.lit(f"{SEED}|"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    return (number(key) % blocks).cast("int")


def exponent(sources: DataFrame, repetitions: float | None = None, entropy: float | None = None) -> float:
    """The exponent for sources(source, tokens). Exactly one target is given."""
    if (repetitions is None) == (entropy is None):
        raise ValueError("give one of repetitions and entropy")
    shares = sources.select((F.col("tokens") / F.sum("tokens").over(Window.partitionBy())).alias("share"))
    low, high = 0.0, TOP if entropy is None else 8.0
    for _ in range(ROUNDS):
        tried = shares.select("share", F.explode(F.sequence(F.lit(0), F.lit(SECTIONS))).alias("i")).withColumn("a", F.lit(low) + F.lit(high - low) * F.col("i") / SECTIONS)
        if entropy is None:
            ends = tried.groupBy("i").agg(F.max("share").alias("most"), F.min("share").alias("least"), F.first("a").alias("a"))
            fits = F.pow(F.col("most") / F.col("least"), 1 - F.col("a")) <= repetitions
        else:
            x = F.pow("share", F.col("a"))
            ends = tried.groupBy("i").agg(F.sum(x).alias("s"), F.sum(x * F.log(x)).alias("sl"))
            fits = F.log("s") - F.col("sl") / F.col("s") < entropy
        at = ends.where(fits).agg(F.min("i")).first()[0]
        at = SECTIONS if at is None else at
        step = high - low
        low, high = low + step * max(0, at - 1) / SECTIONS, low + step * at / SECTIONS
    return high if entropy is None else low


def budgets(sources: DataFrame, power: float, total: int | None = None) -> DataFrame:
    """sources with weight and budget in tokens."""
    raised = sources.withColumn("raised", F.pow(F.col("tokens").cast("double"), F.lit(power)))
    every = Window.partitionBy()
    weighted = raised.withColumn("weight", F.col("raised") / F.sum("raised").over(every))
    all_tokens = F.lit(float(total)) if total is not None else F.max(F.col("tokens") / F.col("weight")).over(every)
    return weighted.select("source", "tokens", "weight", F.round(F.col("weight") * all_tokens).cast("long").alias("budget"))


def permuted_blocks(blocks: DataFrame, shares: DataFrame) -> DataFrame:
    """(source, block, epoch, place): the blocks that each epoch of a source takes, in their order.

    blocks has (source, block, tokens), shares (source, tokens, budget).
    """
    per = shares.select(F.col("source").alias("s"), F.floor(F.col("budget") / F.col("tokens")).cast("int").alias("full"), (F.col("budget") % F.col("tokens")).alias("rest"))
    rows = blocks.join(per, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("full") + 1)))
    key = F.concat_ws("|", F.lit(SEED), F.coalesce("source", F.lit("null")), F.col("epoch").cast("string"), F.col("block").cast("string"))
    order = Window.partitionBy("source", "epoch").orderBy(F.md5(key))
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("upto", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where("epoch <= full or upto <= rest").select("source", "block", "epoch", "place")


def mix(docs: DataFrame, repetitions: float | None = None, entropy: float | None = None, total: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", blocks: int = BLOCKS, details: bool = True) -> DataFrame:
    """docs, each row once for every epoch that takes its block.

    With details _mix_tokens, _mix_epoch, _mix_block and _mix_place are added, in place of columns of these names.
    """
    sized = docs.select(F.col(source_col).cast("string").alias("source"), block_of(id_col, blocks).alias("block"), doc_tokens(text_col).alias("tokens"))
    table = cut(sized.groupBy("source", "block").agg(F.sum("tokens").alias("tokens")), "blocks")
    sources = cut(table.groupBy("source").agg(F.sum("tokens").alias("tokens")), "sources")
    plan = cut(permuted_blocks(table, budgets(sources, exponent(sources, repetitions, entropy), total)), "plan")
    own, source, block, epoch, place = (free_name(docs, f"_mix_{x}") for x in ("own", "source", "block", "epoch", "place"))
    plan = plan.select(F.col("source").alias(source), F.col("block").alias(block), F.col("epoch").alias(epoch), F.col("place").alias(place))
    joined = docs.withColumn(own, block_of(id_col, blocks)).join(plan, F.col(source_col).cast("string").eqNullSafe(F.col(source)) & (F.col(own) == F.col(block))).drop(own, source)
    if not details:
        return joined.select(*docs.columns)
    return joined.withColumns({"_mix_tokens": doc_tokens(text_col), "_mix_block": F.col(block), "_mix_epoch": F.col(epoch), "_mix_place": F.col(place)})
