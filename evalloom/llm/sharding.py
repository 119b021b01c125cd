"""Sharding by fixed virtual slots: records hash to slots, slots carry bytes, and a versioned map sends slots to shards.

A record's slot never changes. The first map deals slots to shards, the largest first to the lightest shard, so shards
get nearly equal bytes; later versions are edits of it that move few slots. The slot table has SLOTS rows at any size, and
each version says how many shards it has.

Defined cases: a null text has no bytes and a null id hashes like any other value. Rows that repeat an id and text are
rows of their own in one slot, which isn't split. A record's size is its UTF-8 bytes plus 1, so empty texts count too. An empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalloom.llm.shared import cut, exists, new_path

SLOTS = 4096


def slot_of(id_col: str, crc_col: str, slots: int) -> Column:
    return F.pmod(F.xxhash64(id_col, crc_col), F.lit(slots)).cast("int")


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """One row per document: id, size, text_crc32, virtual_slot."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.select(F.col(id_col).alias("id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return out.withColumn("virtual_slot", slot_of("id", "text_crc32", slots))


def slot_sizes(recs: DataFrame) -> DataFrame:
    return recs.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n_rows"))


def ordered_slots(slots: DataFrame) -> DataFrame:
    """One row: all slots (virtual_slot, shard, bytes, n_rows) as an array, the largest first. The slot table has a fixed size."""
    return slots.agg(F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "virtual_slot", "shard", "n_rows"))).alias("slots"))


def shard_loads(shards: int) -> Column:
    """Bytes of each shard, of the slots that have one."""
    return F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda k: F.aggregate("slots", F.lit(0).cast("long"), lambda acc, s: acc + F.when(s["shard"] == k, -s["less"]).otherwise(0)))


def folded(slots: DataFrame, shards: int, pick) -> DataFrame:
    """slots with the shard that `pick(loads, slot)` says, one slot after another, the largest first; loads are kept up to date."""
    start = F.struct(shard_loads(shards).alias("loads"), F.array().cast("array<int>").alias("picks"))

    def step(acc: Column, slot: Column) -> Column:
        to = pick(acc["loads"], slot).cast("int")
        after = F.transform(acc["loads"], lambda x, i: x + F.when(~slot["shard"].eqNullSafe(to) & (i == slot["shard"]), slot["less"]).otherwise(0) - F.when(~slot["shard"].eqNullSafe(to) & (i == to), slot["less"]).otherwise(0))
        return F.struct(after.alias("loads"), F.concat(acc["picks"], F.array(to)).alias("picks"))

    dealt = ordered_slots(slots).select(F.arrays_zip("slots", F.aggregate("slots", start, step)["picks"].alias("to")).alias("z")).select(F.explode("z").alias("z"))
    return dealt.select("z.slots.virtual_slot", F.col("z.to").alias("shard"), (-F.col("z.slots.less")).alias("bytes"), "z.slots.n_rows")


def lightest(loads: Column) -> Column:
    return F.array_position(loads, F.array_min(loads)) - 1


def placed(slots: DataFrame, shards: int) -> DataFrame:
    """slots where those without a shard have got one: the largest first, each to the shard that is lightest by then."""
    return folded(slots, shards, lambda loads, slot: F.coalesce(slot["shard"], lightest(loads)))


def first_map(sizes: DataFrame, shards: int) -> DataFrame:
    """(virtual_slot, shard, bytes, n_rows) of slots that have no shard yet."""
    return placed(sizes.withColumn("shard", F.lit(None).cast("int")), shards)


def edited(slots: DataFrame, shards: int) -> DataFrame:
    """The map with one more shard (number `shards`): slots move only into it, from shards that are above the new mean."""
    mean = F.aggregate(shard_loads(shards + 1), F.lit(0).cast("long"), lambda acc, x: acc + x) / (shards + 1)

    def pick(loads: Column, slot: Column) -> Column:
        fits = (F.get(loads, F.lit(shards)) - slot["less"] <= mean) & (F.get(loads, slot["shard"]) + slot["less"] >= mean)
        return F.when(fits, F.lit(shards)).otherwise(slot["shard"])

    return folded(slots, shards + 1, pick)


def rebalanced(slots: DataFrame, shards: int, drift: float) -> DataFrame:
    """The map after slots have moved from shards above (1 + drift) times the mean to the lightest, where that helps."""
    mean = F.aggregate(shard_loads(shards), F.lit(0).cast("long"), lambda acc, x: acc + x) / shards

    def pick(loads: Column, slot: Column) -> Column:
        to = lightest(loads).cast("int")
        helps = (F.get(loads, slot["shard"]) > mean * (1 + drift)) & (F.get(loads, to) - slot["less"] < F.get(loads, slot["shard"]))
        return F.when(helps, to).otherwise(slot["shard"])

    return folded(slots, shards, pick)


def save_map(slots: DataFrame, path: str, version: int, shards: int) -> None:
    """Adds a version, and the number of its shards, to the stored map. Other versions stay as they are; writing one again replaces it."""
    rows = slots.select(F.lit(version).alias("version"), "virtual_slot", "shard", "bytes", "n_rows", F.lit(shards).alias("shards"))
    rows.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the stored map, the last by default."""
    stored = spark.read.schema("virtual_slot int, shard int, bytes long, n_rows long, shards int, version int").parquet(path)
    wanted = F.lit(version) if version is not None else stored.agg(F.max("version")).scalar()
    return stored.where(F.col("version") == wanted)


def measured(slot_map: DataFrame, sizes: DataFrame) -> DataFrame:
    """The map's slots with their bytes and rows as they are now, 0 where they have no records; slots that are new have no shard."""
    old = slot_map.select(F.col("virtual_slot").alias("_slot"), F.col("shard").alias("_shard"))
    both = sizes.join(old, F.col("virtual_slot") == F.col("_slot"), "full")
    return both.select(F.coalesce("virtual_slot", "_slot").alias("virtual_slot"), F.col("_shard").alias("shard"), F.coalesce("bytes", F.lit(0).cast("long")).alias("bytes"), F.coalesce("n_rows", F.lit(0).cast("long")).alias("n_rows"))


def current_map(sizes: DataFrame, shards: int, path: str, drift: float | None = None) -> DataFrame:
    """The map to assign by: the stored one, or an edit of it that is stored as the next version, or a first one.

    A slot changes its shard only if shards were added, or if `drift` is given and the fullest shard is above (1 + drift) times
    the mean. Slots that had no records before are dealt to the lightest shards. Fewer shards than the map has are refused.
    """
    spark = sizes.sparkSession
    if not exists(spark, path):
        save_map(first_map(sizes, shards), path, 1, shards)
        return measured(load_map(spark, path), sizes)
    stored = load_map(spark, path)
    version, before = stored.agg(F.max("version"), F.max("shards")).first()
    before = before or shards  # a map of an empty table says nothing
    if before > shards:
        raise ValueError(f"the stored map has {before} shards, {shards} are asked for")
    now = cut(measured(stored, sizes), "slots")
    changed = before < shards or bool(now.where("shard is null").limit(1).count())
    now = cut(placed(now, before), "slots")
    for n in range(before, shards):
        now = cut(edited(now, n), "slots")
    if drift is not None:
        loads = now.groupBy("shard").agg(F.sum("bytes").alias("b")).agg(F.max("b"), F.sum("b")).first()
        if (loads[0] or 0) > (1 + drift) * (loads[1] or 0) / shards:
            now, changed = cut(rebalanced(now, shards, drift), "slots"), True
    if changed:
        save_map(now, path, (version or 0) + 1, shards)
    return now


def assign(recs: DataFrame, slot_map: DataFrame) -> DataFrame:
    """recs with shard and slot, the record's place in its shard: 0, 1, ... without gaps.

    A place is the rows in the shard's earlier virtual slots plus the place in its own, so no shard is ever sorted whole.
    The map has at most SLOTS rows, which is what is broadcast.
    """
    earlier = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    places = slot_map.select("virtual_slot", "shard", F.coalesce(F.sum("n_rows").over(earlier), F.lit(0)).alias("_before"))
    own = Window.partitionBy("virtual_slot").orderBy("id", "text_crc32", "size")
    out = recs.withColumn("_own", F.row_number().over(own)).join(F.broadcast(places), "virtual_slot")
    return out.withColumn("slot", (F.col("_before") + F.col("_own") - 1).cast("long")).drop("_before", "_own")


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, map_path: str | None = None, drift: float | None = None) -> DataFrame:
    """One row per document: id, size, text_crc32, shard, slot (place in the shard), virtual_slot. Shards are nearly equal in bytes.

    map_path is where the versioned map is stored: documents added later go by the stored map, and added shards, or loads that
    have drifted apart, edit it. Without one the map is new and stored in the shared folder.
    """
    recs = cut(records(docs, id_col, text_col, slots), "records")
    slot_map = cut(current_map(slot_sizes(recs), shards, map_path or new_path(docs.sparkSession, "map"), drift), "slots")
    out = assign(recs, slot_map)
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "slot", "virtual_slot")
