"""Consistent-hash ring with virtual nodes and bounded loads.

Every key (doc_id with its text, and the number of the copy where a row repeats) has a place on a ring of cells; each shard owns many virtual nodes there. A key goes to the
next virtual node clockwise whose shard still has room; a shard has room up to (1 + slack) times the mean load, so loads are
near equal, and adding a shard moves few keys. Loads are counted per cell in Spark; only the table of cells (65,536 rows of 20
bytes at most, whatever the input) is walked on the driver, and it comes back as a broadcast of that bound.

Of the laws of the query this is `bytes`: sizes are near equal. Equal texts of different documents are different keys and may
part, and so may copies of a row: they are counted, then dealt out by number, COPIES at a time.
Defined cases: a null text has size 1 and CRC 0; null doc_ids are keys like others; of repeated rows each copy is a key; a key
larger than any shard's room goes to the emptiest shard, and the others fill up around it; very long texts are only hashed and measured; other
columns are not read, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELL_BITS, COPIES = 16, 1024


def ring(shards: int, virtual: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the virtual nodes in clockwise order and the shard of each."""
    places = sorted((int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big") % cells, s) for s in range(shards) for v in range(virtual))
    return np.array([p for p, _ in places]), np.array([s for _, s in places])


def assign_cells(cell: np.ndarray, load: np.ndarray, shards: int, virtual: int = 128, slack: float = 0.0005, cells: int = 1 << CELL_BITS) -> np.ndarray:
    """The shard of each cell. Heavy cells are seated first (ties: clockwise), each at the first virtual node whose shard has room."""
    places, owners = ring(shards, virtual, cells)
    room = np.full(shards, (1 + slack) * load.sum() / shards)
    out = np.zeros(len(cell), np.int32)
    for i in np.lexsort((cell, -load)):
        at = int(np.searchsorted(places, cell[i]))
        full: set[int] = set()
        chosen = -1
        for k in range(len(owners)):
            shard = int(owners[(at + k) % len(owners)])
            if shard in full:
                continue
            if room[shard] >= load[i]:
                chosen = shard
                break
            full.add(shard)
            if len(full) == shards:
                break
        chosen = int(np.argmax(room)) if chosen < 0 else chosen
        room[chosen] -= load[i]
        out[i] = chosen
    return out


def shard(docs: DataFrame, shards: int, virtual: int = 128, slack: float = 0.0005) -> DataFrame:
    """doc_id, size, text_crc32, cell, shard and slot (gapless from 0 in each shard) of every document."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    same = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(F.col("doc_id").cast("long"), text).alias("first"),
    ).groupBy("doc_id", "size", "text_crc32", "first").agg(F.count(F.lit(1)).alias("copies"))
    parts = same.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES)))).repartition("first", "part")
    last = F.least(F.col("copies"), (F.col("part") + 1) * COPIES) - 1
    rows = parts.withColumn("copy", F.explode(F.sequence(F.col("part") * COPIES, last))).withColumn("place", F.when(F.col("copy") == 0, F.col("first")).otherwise(F.xxhash64("first", "copy")))
    rows = rows.select("doc_id", "size", "text_crc32", "copy", "place", F.shiftrightunsigned("place", 64 - CELL_BITS).cast("int").alias("cell"))
    loads = rows.groupBy("cell").agg(F.sum("size").alias("load"), F.count(F.lit(1)).alias("n")).toPandas().sort_values("cell", ignore_index=True)
    loads["shard"] = assign_cells(loads["cell"].to_numpy(), loads["load"].to_numpy(np.float64), shards, virtual, slack)
    loads["before"] = loads.groupby("shard")["n"].cumsum() - loads["n"]
    table = spark.createDataFrame(loads[["cell", "shard", "before"]], "cell int, shard int, before long")
    order = Window.partitionBy("cell").orderBy("place", "doc_id", "size", "text_crc32", "copy")
    placed = rows.withColumn("nth", F.row_number().over(order))
    return placed.join(F.broadcast(table), "cell").select("doc_id", "size", "text_crc32", "cell", "shard", (F.col("before") + F.col("nth") - 1).alias("slot"))
