"""Operator 10, sharding: fixed virtual slots and a versioned slot-to-shard map.

Records hash into a fixed number of slots, bytes are summed per slot (with
map-side combine), and a map from slot to shard, of exactly as many rows as
there are slots, is written under a shared folder with a version number.
Rebalancing loads the newest version, edits it and stores the next one: only
rows of slots whose shard changes move, and moved_rows names them. Equal texts
are spread over slots like other rows (the slot's hash takes the id first), so
a text that a third of all rows hold fills no slot; text_crc32 finds its copies.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.store import shared_folder
from .common import read_table, stored

SLOTS, SHARDS, OVERHEAD = 8192, 40, 16
MAP = T.StructType([T.StructField("virtual_slot", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("version", T.IntegerType())])


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD


def slot_of(id_col: Column, text: Column, slots: int = SLOTS) -> Column:
    """The slot of a record; the text takes part, so that rows without an id spread as well."""
    return F.pmod(F.xxhash64(id_col, F.crc32(F.coalesce(text, F.lit("")).cast("binary"))), F.lit(slots)).cast("int")


def plan(sizes: dict[int, int], shards: int, slots: int = SLOTS) -> dict[int, int]:
    """Largest slot first to the lightest shard; slots without rows go last, in turn. At most `slots` entries."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for slot in sorted(range(slots), key=lambda k: (-sizes.get(k, 0), k)):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + sizes.get(slot, 0), shard))
    return out


def rebalance(old: dict[int, int], sizes: dict[int, int], shards: int) -> dict[int, int]:
    """old, edited for `shards` shards: slots leave removed shards and those above the mean, each to the lightest shard, and no others move."""
    loads = {s: 0 for s in range(shards)}
    by: dict[int, list[int]] = {s: [] for s in range(shards)}
    homeless, out = [], dict(old)
    for slot, shard in old.items():
        if shard in loads:
            loads[shard] += sizes.get(slot, 0)
            by[shard].append(slot)
        else:
            homeless.append(slot)
    mean = sum(sizes.values()) / max(1, shards)
    for shard, own in by.items():
        for slot in sorted(own, key=lambda k: (sizes.get(k, 0), k), reverse=True):
            size = sizes.get(slot, 0)
            if size and loads[shard] - size >= mean:
                loads[shard] -= size
                homeless.append(slot)
    heap = [(load, s) for s, load in loads.items()]
    heapq.heapify(heap)
    for slot in sorted(homeless, key=lambda k: (-sizes.get(k, 0), k)):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + sizes.get(slot, 0), shard))
    return out


def slot_bytes(rows: DataFrame) -> dict[int, int]:
    """Bytes by slot; the driver gets at most as many rows as there are slots."""
    return {r[0]: r[1] for r in rows.groupBy("virtual_slot").agg(F.sum("size")).collect()}


def write_map(spark: SparkSession, slot_map: dict[int, int], folder: str, version: int) -> DataFrame:
    """Store the map as its own version; earlier versions stay as they are, and a version that exists is an error."""
    path = f"{folder}/version={version}"
    spark.createDataFrame([(k, v, version) for k, v in slot_map.items()], MAP).coalesce(1).write.mode("errorifexists").parquet(path)
    return spark.read.schema(MAP).parquet(path)


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The complete versions of the map in the folder, oldest first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("version=")]
    return sorted(int(p.getName().split("=")[1]) for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The map of a version (the newest: None): virtual_slot, shard, version."""
    known = versions(spark, folder)
    if not known or version is not None and version not in known:
        raise ValueError(f"no version {'' if version is None else version} of a slot map in {folder}")
    return spark.read.schema(MAP).parquet(f"{folder}/version={known[-1] if version is None else version}")


def edit_map(rows: DataFrame, folder: str, shards: int) -> tuple[DataFrame, DataFrame]:
    """Edit the newest map for the bytes that rows(virtual_slot, size) have now and for `shards` shards, and store it as the next version.

    Gives the new map and its moves (virtual_slot, from_shard, to_shard). Where nothing needs to move the new version equals the old one.
    """
    spark = rows.sparkSession
    old = load_map(spark, folder)
    newest = versions(spark, folder)[-1]
    slot_map = {r.virtual_slot: r.shard for r in old.collect()}  # one row a slot
    new = write_map(spark, rebalance(slot_map, slot_bytes(rows), shards), folder, newest + 1)
    moves = old.select("virtual_slot", F.col("shard").alias("from_shard")).join(new.select("virtual_slot", F.col("shard").alias("to_shard")), "virtual_slot").where("from_shard <> to_shard")
    return new, moves


def moved_rows(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """The rows(virtual_slot, ...) that go from one shard to another, with from_shard and to_shard; moves has at most one row a slot."""
    return rows.join(F.broadcast(moves), "virtual_slot")


def slotted(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, virtual_slot. Null text has no bytes, only the overhead."""
    text = F.col(text_col)
    crc = F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
    return docs.select(F.col(id_col).alias("doc_id"), size_of(text).alias("size"), crc.alias("text_crc32"), slot_of(F.col(id_col), text, slots).alias("virtual_slot"))


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """One row per row of docs: id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot.

    The law is `bytes`: sizes of shards are near equal, to within about one
    slot. slot is the row's place in its shard, gapless from 0, ordered by
    virtual slot, then id; ties (repeated rows) take places in any order.
    grown_shard is null under this law. Null text has no bytes, only the
    overhead. Copies of one row share a slot; other columns are ignored; an
    empty table gives no rows. folder: where the map is kept; if it holds one,
    its newest version decides, else version 1 is planned from the sizes.
    """
    spark = docs.sparkSession
    rows = stored(slotted(docs, slots, id_col, text_col), "sharded")
    folder = folder or f"{shared_folder(spark)}/tidemark-slot-map-{uuid.uuid4().hex}"
    slot_map = load_map(spark, folder) if versions(spark, folder) else write_map(spark, plan(slot_bytes(rows), shards, slots), folder, 1)
    return placed(rows, slot_map)


def placed(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Rows of slotted() under a map: their shard and gapless place in it."""
    slot_map = slot_map.select("virtual_slot", "shard")
    counts = rows.groupBy("virtual_slot").agg(F.count("*").alias("n")).join(slot_map, "virtual_slot")
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("virtual_slot", "shard", F.coalesce(before, F.lit(0)).alias("base"))  # one row per slot
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(F.col("doc_id"), "text_crc32"))
    return rows.join(F.broadcast(bases), "virtual_slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("base") + place - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read_table(spark, sf_dir, "documents"))
