"""Sharding by fixed virtual slots (operator 5).

Records are hashed into a fixed number of slots, bytes are aggregated per slot, and a slot-to-shard map assigns slots
to shards so that the shards' bytes are near equal. The map is a versioned table; rebalancing edits the map and moves
whole slots. A record's slot never changes.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factengine.llm.common import materialise, new_path

#: The share of a fair shard up to which equal texts stay together; a larger group cannot fit into near equal shards.
FAIR = 0.95
#: Identical rows that are numbered as one.
CHUNK = 1024
MAP_SCHEMA = "version int, virtual_slot int, bytes long, shard int"


def assign_slots(bytes_per_slot: dict[int, int], shards: int) -> dict[int, int]:
    """Largest slot first to the lightest shard; ties by number."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for slot, size in sorted(bytes_per_slot.items(), key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def rebalance(slot_map: dict[int, int], bytes_per_slot: dict[int, int], shards: int) -> dict[int, int]:
    """The next version of a map for ``shards`` shards: slots move one by one from the heaviest shard that can give one to
    the lightest, as long as that narrows their gap; slots of shards that are no more are dealt out first. All else stays."""
    out = dict(slot_map)
    load = {s: 0 for s in range(shards)}
    homeless = []
    for slot in sorted(out):
        if out[slot] in load:
            load[out[slot]] += bytes_per_slot.get(slot, 0)
        else:
            homeless.append(slot)
    for slot in sorted(homeless, key=lambda x: (-bytes_per_slot.get(x, 0), x)):
        out[slot] = min(load, key=lambda s: (load[s], s))
        load[out[slot]] += bytes_per_slot.get(slot, 0)
    held: dict[int, set[int]] = {s: set() for s in load}
    for slot, at in out.items():
        if bytes_per_slot.get(slot, 0):
            held[at].add(slot)
    for _ in range(len(out)):
        low = min(load, key=lambda s: (load[s], s))
        for high in sorted(load, key=lambda s: (-load[s], s)):
            gap = load[high] - load[low]
            fits = [x for x in held[high] if bytes_per_slot[x] < gap]
            if fits:
                break
        else:
            break
        slot = min(fits, key=lambda x: (abs(gap - 2 * bytes_per_slot[x]), x))
        out[slot] = low
        held[high].remove(slot)
        held[low].add(slot)
        load[high] -= bytes_per_slot[slot]
        load[low] += bytes_per_slot[slot]
    return out


def save_map(spark: SparkSession, path: str, version: int, slot_map: dict[int, int], bytes_per_slot: dict[int, int]) -> DataFrame:
    """Writes one version of the map table at ``path``, over that version only; all versions stay readable there."""
    rows = [(k, int(bytes_per_slot.get(k, 0)), v) for k, v in sorted(slot_map.items())]
    spark.createDataFrame(rows, "virtual_slot int, bytes long, shard int").coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")
    return read_map(spark, path, version)


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(MAP_SCHEMA).parquet(path).where(F.col("version") == version)


def rebalance_map(spark: SparkSession, path: str, version: int, shards: int) -> DataFrame:
    """The next version of a stored map, edited for ``shards`` shards; it is stored as ``version + 1``."""
    held = read_map(spark, path, version).collect()  # a row per virtual slot
    sizes = {r.virtual_slot: r.bytes for r in held}
    return save_map(spark, path, version + 1, rebalance({r.virtual_slot: r.shard for r in held}, sizes, shards), sizes)


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", virtual_slots: int = 4096, map_path: str | None = None, version: int = 1) -> DataFrame:
    """Per row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot``.

    ``size`` is the text's UTF-8 bytes plus 16 (null text: 16, checksum 0). ``law`` is ``bytes``: shards are near equal
    in size, so the map depends on the data and ``grown_shard`` is null. ``slot`` counts a shard's rows from 0 without
    gaps, by virtual slot. Equal texts share a virtual slot, unless together they are larger than 0.95 of a fair shard;
    such a group is dealt, by id and copy, to the least number of slots in which its parts are about an eighth of a shard.
    Identical rows are counted, not moved, and their order among themselves means nothing. Null ids count as equal. An
    empty table gives no rows; extra columns are ignored. Records find their shard through the stored map: this version
    of the table at ``map_path``, by default in the session's shared folder.

    What reaches the driver is a row per virtual slot, one per part of a slot that has many rows (at most twice as many
    as slots), and the groups above 0.95 of a shard, of which there are at most a few more than shards.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"))
    rows = materialise(rows.groupBy("doc_id", "size", "text_crc32", "text_hash").agg(F.count("*").alias("copies")), "records")
    total = rows.agg(F.sum(F.col("size") * F.col("copies"))).first()[0] or 0
    groups = rows.groupBy("text_hash", "text_crc32").agg(F.sum(F.col("size") * F.col("copies")).alias("bytes"))
    large = {r.text_hash: -(-r.bytes * 8 * shards // total) for r in groups.where(F.col("bytes") * shards > FAIR * total).collect()}
    parts = F.create_map(*(F.lit(x) for pair in large.items() for x in pair)) if large else F.create_map(F.lit(0).cast("long"), F.lit(1))
    rows = rows.withColumn("parts", F.coalesce(F.try_element_at(parts, "text_hash"), F.lit(1)).cast("long"))
    # copies of a row of a large group go to its parts in turn
    spread = F.least("copies", "parts")
    rows = rows.withColumn("nth", F.explode(F.sequence(F.lit(0), (spread - 1).cast("int"))))
    part = F.pmod(F.xxhash64("doc_id") + F.col("nth"), F.col("parts"))
    slot = F.pmod(F.when(F.col("parts") > 1, F.xxhash64("text_hash", part)).otherwise(F.xxhash64("text_hash")), F.lit(virtual_slots)).cast("int")
    copies = F.floor(F.col("copies") / spread) + (F.col("nth") < F.col("copies") % spread).cast("long")
    rows = rows.select("doc_id", "size", "text_crc32", "text_hash", slot.alias("virtual_slot"), "nth", copies.alias("copies"))
    counted = {r.virtual_slot: (r.bytes, r.n) for r in rows.groupBy("virtual_slot").agg(F.sum(F.col("size") * F.col("copies")).alias("bytes"), F.sum("copies").alias("n")).collect()}
    sizes = {k: b for k, (b, _) in counted.items()}
    slot_map = save_map(spark, map_path or new_path(spark, "slot_map"), version, assign_slots(sizes, shards), sizes)
    at = {r.virtual_slot: r.shard for r in slot_map.collect()}
    # a slot with many rows is numbered in parts
    usual = max(CHUNK, -(-sum(n for _, n in counted.values()) // virtual_slots))
    pieces = F.broadcast(spark.createDataFrame([(k, -(-n // usual)) for k, (_, n) in counted.items()], "virtual_slot int, pieces long"))
    chunks = F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / CHUNK).cast("int")))
    rows = rows.withColumn("chunk", chunks).withColumn("copies", F.least(F.lit(CHUNK), F.col("copies") - F.col("chunk") * CHUNK))
    rows = rows.join(pieces, "virtual_slot").withColumn("piece", F.pmod(F.xxhash64("doc_id", "text_crc32", "nth", "chunk"), F.col("pieces")))
    held = {(r.virtual_slot, r.piece): r.n for r in rows.groupBy("virtual_slot", "piece").agg(F.sum("copies").alias("n")).collect()}
    placed, filled = [], [0] * shards
    for k, piece in sorted(held):
        placed.append((k, piece, at[k], filled[at[k]]))
        filled[at[k]] += int(held[k, piece])
    lookup = F.broadcast(spark.createDataFrame(placed, "virtual_slot int, piece long, shard int, base long"))
    order = Window.partitionBy("virtual_slot", "piece").orderBy("doc_id", "text_crc32", "size", "text_hash", "nth", "chunk")
    before = F.coalesce(F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = rows.withColumn("before", before).join(lookup, ["virtual_slot", "piece"])
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("before") + F.col("copy")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
