"""Contiguous shards of equal size in bytes.

Rows are dealt out in ranges of their order; each range is summed on its own, the few range totals are summed up to
give every range its starting offset, and a row's offset in the whole corpus decides its shard: the total is cut at
equal targets, and a row belongs to the shard in which its middle byte lies. So shards are contiguous in the order and
differ from the target by less than one row at either end. Only id, size and checksum are shuffled, never the text.

Defined results: null text has no bytes and size 1; null ids come first; rows that share an id follow one another by
checksum and size, and identical rows in an order of no consequence; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from itemloom.llm.store import stored


def byte_shards(docs: DataFrame, shards: int = 16, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Shard and slot of every row: the id, size, text_crc32, offset (bytes before it), shard, slot (from 0)."""
    text = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    sized = docs.select(
        F.col(id_column).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"),
        # tells rows with the same id apart, so that one id in a third of all rows still falls into many ranges
        F.monotonically_increasing_id().alias("tie"),
    )
    order = ["id", "crc", "size", "tie"]
    ranges = stored(sized.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    totals = ranges.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range: as many as there are shuffle partitions
    offsets = totals.select(
        F.col("part").alias("o_part"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"),
    )
    local = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = ranges.withColumns({"upto": F.sum("size").over(local), "nth": F.count("*").over(local)}).join(
        F.broadcast(offsets), F.col("part") == F.col("o_part")
    )
    start = F.col("bytes_before") + F.col("upto") - F.col("size")
    # whole numbers: exact up to 2**63 / (2 * shards) bytes, 288 PB for 16 shards
    shard = F.least(F.expr(f"CAST((2 * (bytes_before + upto - size) + size) * {shards} div (2 * all_bytes) AS INT)"), F.lit(shards - 1))
    cut = stored(placed.select(
        "id", "size", F.col("crc").alias("text_crc32"), start.alias("offset"), shard.alias("shard"),
        (F.col("rows_before") + F.col("nth") - 1).alias("place"),
    ), "placed")
    firsts = cut.groupBy("shard").agg(F.min("place").alias("first")).withColumnRenamed("shard", "f_shard")
    return cut.join(F.broadcast(firsts), F.col("shard") == F.col("f_shard")).select(
        F.col("id").alias(id_column), "size", "text_crc32", "offset", "shard", (F.col("place") - F.col("first")).alias("slot")
    )
