"""Sharding by fixed virtual slots.

Every record hashes by its id, size, text and copy number (0 but for rows that repeat) into one of a fixed number of virtual slots. Bytes are summed
per slot, and a versioned slot-to-shard map says where each slot lives. Rebalancing edits the map, never the
hash, so only the slots that the edit names move. Everything is DataFrame and SQL functions.

The slot count bounds the map (4,096 rows), whatever the input size. Rows are numbered in groups of one slot
and one of ``PARTS`` parts, which follow the partitions that the rows were read in, so that one id, null ids or
copies of one row are split like any others.

Cases: a null text counts as no bytes; a null id hashes like any other value, with its text; equal rows are told
apart by their number among the equal ones of a part, so they spread over slots and shards, and get positions of their own; very long texts are only measured; an empty table gives
an empty result; input columns besides the two named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from traceforge.llm.shared import new_path, stored

SLOTS = 4096
#: Parts that the rows of a slot are numbered in.
PARTS = 64
MAP_SCHEMA = "version int, slot int, shard int, slot_bytes bigint"


def measured(df: DataFrame, key: str, text: str, slots: int = SLOTS) -> DataFrame:
    """``(key, size, text_crc32, virtual_slot, part)`` of every row; a size is the text's UTF-8 bytes plus 1."""
    body = F.coalesce(F.encode(F.col(text), "utf-8"), F.lit(b""))
    rows = df.select(F.col(key).alias("key"), (F.octet_length(body).cast("long") + F.lit(1)).alias("size"), F.crc32(body).cast("long").alias("text_crc32"))
    parts = rows.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    copy = F.row_number().over(Window.partitionBy("key", "size", "text_crc32", "part").orderBy("part")) - 1
    slot = F.pmod(F.xxhash64("key", "size", "text_crc32", "copy"), F.lit(slots)).cast("int")
    return parts.withColumn("copy", copy).select("key", "size", "text_crc32", slot.alias("virtual_slot"), "part")


def slot_bytes(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Bytes per virtual slot of measured rows; one row for every slot, empty ones included."""
    sums = rows.groupBy(F.col("virtual_slot").alias("slot")).agg(F.sum("size").alias("slot_bytes"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot"))
    return every.join(sums, "slot", "left").select("slot", F.coalesce("slot_bytes", F.lit(0)).cast("long").alias("slot_bytes"))


def initial_map(sums: DataFrame, shards: int) -> DataFrame:
    """Version 0: slots dealt round robin, before any size is known."""
    return sums.select(F.lit(0).alias("version"), "slot", F.pmod("slot", F.lit(shards)).cast("int").alias("shard"), "slot_bytes")


def rebalanced(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version of a map: ``shards`` shards of near-equal bytes, most slots left where they are.

    Slots go from large to small. A slot keeps its shard while that shard stays within the mean load, else
    it moves to the lightest shard. The fold runs over one array of all slots, whose length is fixed.
    """
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("slot_bytes")).alias("neg"), "slot", "shard")))
    one = slot_map.agg(ordered.alias("s"), F.max("version").alias("v"), (F.sum("slot_bytes") / shards).alias("mean"))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("load"), F.array().cast("array<int>").alias("to"))

    def place(acc: Column, slot: Column) -> Column:
        size = -slot["neg"]
        lightest = F.array_position(acc["load"], F.array_min(acc["load"])).cast("int") - 1
        stays = (slot["shard"] < shards) & (F.coalesce(F.get(acc["load"], slot["shard"]), F.lit(0)) + size <= F.col("mean"))
        to = F.when(stays, slot["shard"]).otherwise(lightest)
        load = F.transform(acc["load"], lambda x, i: F.when(i == to, x + size).otherwise(x))
        return F.struct(load.alias("load"), F.concat(acc["to"], F.array(to)).alias("to"))

    placed = one.withColumn("to", F.aggregate("s", start, place)["to"])
    pairs = placed.select("v", F.explode(F.arrays_zip("s", "to")).alias("p"))
    return pairs.select((F.col("v") + 1).cast("int").alias("version"), F.col("p.s.slot").alias("slot"), F.col("p.to").alias("shard"), (-F.col("p.s.neg")).alias("slot_bytes"))


def store_map(slot_map: DataFrame, path: str) -> None:
    """Add one version to the stored map table."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of a stored map, the latest unless named."""
    table = spark.read.schema(MAP_SCHEMA).parquet(path)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    return table.where(F.col("version") == version)


def assign(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Measured rows with their ``shard`` by a map, which has one row per slot and so may be broadcast."""
    return rows.join(F.broadcast(slot_map.select(F.col("slot").alias("virtual_slot"), "shard")), "virtual_slot")


def numbered(rows: DataFrame) -> DataFrame:
    """A gapless position from 0 in each shard: rows are ranked in their slot and part, and every such group starts
    where those before it in the shard end. The starts (slots times parts at most, 262,144 rows) may be broadcast."""
    group = ["virtual_slot", "part"]
    counts = rows.groupBy("shard", *group).agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy(*group).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("key", "size", "text_crc32"))
    placed = rows.withColumn("rank", rank).join(F.broadcast(starts), group)
    return placed.withColumn("slot", (F.col("start") + F.col("rank") - 1).cast("long")).drop("rank", "start")


def shard_by_bytes(df: DataFrame, key: str, text: str, shards: int, path: str | None = None, slots: int = SLOTS) -> DataFrame:
    """Rows of ``df`` as ``(key, size, text_crc32, law, shard, slot, grown_shard, virtual_slot)``.

    The map is stored under ``path`` in two versions: the round-robin one and the one edited by bytes. The measured
    rows (without texts) are written, so that texts are read once and a row's part is fixed.
    """
    spark = df.sparkSession
    path = path or new_path(spark, "slot-map")
    rows = stored(measured(df, key, text, slots), "measured")
    store_map(initial_map(slot_bytes(rows, slots), shards), path)
    store_map(rebalanced(load_map(spark, path, 0), shards), path)
    placed = numbered(assign(rows, load_map(spark, path)))
    return placed.select(F.col("key").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
