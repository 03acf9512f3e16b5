"""Sharding by longest-processing-time scheduling.

Rows with equal texts form a group that must stay together. Groups sorted by
size go, largest first, to the least-loaded shard through a heap.

The heap runs on the driver, so what it sees is bounded: with T bytes in all, a
unit is T / (n_shards * units_per_shard) bytes. Groups of at least one unit are
scheduled on their own; there are at most n_shards * units_per_shard of them.
Smaller groups, sorted by size, are cut by running total into bundles of about
one unit, as many at most, which are scheduled like groups. Shards thus end up
within about two units of each other, unless one group alone exceeds a shard.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import cut, ordinal, table


def schedule(sizes: list[int], n_shards: int) -> list[int]:
    """Shard of each size: longest processing time first, ties by position."""
    heap = [(0, s) for s in range(n_shards)]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        load, s = heap[0]
        out[i] = s
        heapq.heapreplace(heap, (load + sizes[i], s))
    return out


def shard(docs: DataFrame, n_shards: int = 24, units_per_shard: int = 1000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    size is the UTF-8 length of the text plus 8; a null text has no bytes, its
    checksum is that of the empty text, and null texts form one group of their
    own. Empty texts are one group too. Repeated rows stay separate rows of one
    group and get slots of their own. An empty table gives an empty result.
    slot counts the rows of a shard from 0 in order of doc_id (null first).
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    rows = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit(""))).cast("long").alias("text_crc32"),
            F.coalesce(F.unhex(F.sha2(text, 256)), F.unhex(F.lit("00"))).alias("key"),
        )
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    unit = max(1, -(-total // (n_shards * units_per_shard)))
    groups = cut(rows.groupBy("key").agg(F.sum("size").alias("g_size")))
    large, small = groups.filter(F.col("g_size") >= unit), groups.filter(F.col("g_size") < unit)

    order = [F.col("g_size").desc(), F.col("key")]
    placed = cut(small.repartitionByRange(*order).withColumn("pid", F.spark_partition_id()))
    sums = placed.groupBy("pid").agg(F.sum("g_size").alias("p_size"))
    offsets = sums.withColumn("offset", F.sum("p_size").over(Window.orderBy("pid")) - F.col("p_size")).drop("p_size")
    inside = Window.partitionBy("pid").orderBy(*order)
    running = placed.withColumn("upto", F.sum("g_size").over(inside) - F.col("g_size"))
    bundled = cut(running.join(F.broadcast(offsets), "pid").select("key", "g_size", F.floor((F.col("upto") + F.col("offset")) / unit).alias("bundle")))

    alone = [(bytes(r.key), r.g_size) for r in large.collect()]
    alone.sort()
    bundles = sorted((r.bundle, r.b_size) for r in bundled.groupBy("bundle").agg(F.sum("g_size").alias("b_size")).collect())
    at = schedule([s for _, s in alone] + [s for _, s in bundles], n_shards)
    of_large = spark.createDataFrame([(bytearray(k), at[i]) for i, (k, _) in enumerate(alone)], "key binary, large_shard int")
    of_bundle = spark.createDataFrame([(b, at[len(alone) + i]) for i, (b, _) in enumerate(bundles)], "bundle long, shard int")

    # at most n_shards * units_per_shard rows (plus one) in either broadcast
    marked = rows.join(F.broadcast(of_large), "key", "left")
    of_small = bundled.join(F.broadcast(of_bundle), "bundle").select("key", "shard")
    put = marked.filter("large_shard is not null").withColumnRenamed("large_shard", "shard")
    put = put.unionByName(marked.filter("large_shard is null").drop("large_shard").join(of_small, "key"))
    slots = ordinal(put.drop("key"), ["shard"], [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))


def op4_sharding(spark, sf_dir):
    return shard(table(spark, sf_dir, "documents"))
