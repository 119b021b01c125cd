"""What the training-data operators share: lineage cuts in the shared folder, row keys, components, tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.storage import cut, discard, exists, new_path, shared_dir

__all__ = ["components", "cut", "discard", "exists", "free_name", "has_repeated_ids", "new_path", "shared_dir", "small_batches", "tiles", "utf8"]

#: Rows that one Arrow batch may hold while texts are in it; bounds a Python worker's memory.
TEXT_BATCH = 256


def small_batches(spark: SparkSession) -> None:
    """Lowers the rows in an Arrow batch, since a row can be a very long text. Leaves a lower setting alone."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_BATCH:
        spark.conf.set(key, str(TEXT_BATCH))


def utf8(column: str) -> Column:
    """The column's UTF-8 bytes."""
    return F.col(column).cast("string").cast("binary")


def free_name(df: DataFrame, base: str) -> str:
    """base, or base with a number if df has such a column."""
    taken, name, k = {c.lower() for c in df.columns}, base, 0
    while name.lower() in taken:
        name, k = f"{base}{k}", k + 1
    return name


def has_repeated_ids(df: DataFrame, id_col: str) -> bool:
    """Whether ids are null or occur twice. Reads the id column alone."""
    odd = df.groupBy(F.col(id_col).alias("id")).count().where("count > 1 or id is null")
    return bool(odd.limit(1).count())


def tiles(members: DataFrame, group: list[str], spread: Column, size: int) -> DataFrame:
    """Splits every group into blocks of about `size` rows and deals each pair of blocks to a tile of its own.

    Groups of one row are left out. Adds `_block`, `_lo` and `_hi` (the tile's two blocks) and `_tile` (its hash).
    A group of up to `size` rows is a single tile; a hot one becomes many tiles of at most about 2 * size rows.
    """
    sizes = members.groupBy(*group).agg(F.count(F.lit(1)).alias("_size")).where("_size > 1")
    keys = [F.col(f"m.{c}").eqNullSafe(F.col(f"s.{c}")) for c in group]
    on = keys[0]
    for k in keys[1:]:
        on = on & k
    joined = members.alias("m").join(sizes.alias("s"), on).select("m.*", "s._size")
    blocks = F.ceil(F.col("_size") / F.lit(size)).cast("int")
    out = joined.withColumn("_blocks", blocks).withColumn("_block", F.pmod(spread, F.col("_blocks")).cast("int"))
    out = out.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    out = out.withColumn("_lo", F.least("_block", "_other")).withColumn("_hi", F.greatest("_block", "_other"))
    return out.withColumn("_tile", F.xxhash64(*group, "_lo", "_hi")).drop("_size", "_blocks", "_other")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph as (id, component): component is the smallest id reachable.

    Each round points every vertex at its smallest neighbour, follows the pointers to their roots by doubling and
    contracts the graph to the roots; only vertices with an edge are returned. All steps are aggregates with a
    partial side and equi-joins, so a vertex with very many edges is split by the skew join.
    """
    live = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct()
    live = cut(live, "edges")
    labels = None
    while live.limit(1).count():
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")).withColumnRenamed("a", "id")
        parent = cut(parent, "parents")
        while True:
            up = parent.select(F.col("id").alias("u"), F.col("p").alias("pp"))
            jumped = cut(parent.join(up, F.col("p") == F.col("u")).select("id", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), "parents")
            discard(parent)
            parent = jumped.select("id", "p")
            if not jumped.where("moved").limit(1).count():
                break
        left = parent.select(F.col("id").alias("a"), F.col("p").alias("pa"))
        right = parent.select(F.col("id").alias("b"), F.col("p").alias("pb"))
        rest = live.join(left, "a").join(right, "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct()
        rest = cut(rest, "edges")
        discard(live)
        live = rest
        if labels is None:
            labels = parent
        else:
            to = parent.select(F.col("id").alias("u"), F.col("p").alias("pp"))
            later = cut(labels.join(to, F.col("p") == F.col("u"), "left").select("id", F.coalesce("pp", "p").alias("p")), "labels")
            discard(labels, parent)
            labels = later
    if labels is None:
        labels = live.select(F.col("a").alias("id"), F.col("b").alias("p"))
    return labels.select("id", F.col("p").alias("component"))
