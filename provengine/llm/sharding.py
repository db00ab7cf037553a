"""Sharding: contiguous shards of near-equal bytes, cut from global prefix sums. DataFrame functions only.

Rows stand in the order of (id, checksum, size), nulls first; each has a size of its text's UTF-8 bytes
plus `overhead`. A row goes to the shard in which its middle byte falls when the whole is cut at equal
targets, so a shard misses its target by half a row at either end. Null ids and texts are rows like
others (a null text has no bytes and checksum 0); rows that repeat keep one place each; empty input
gives no rows; columns beside the two named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prefix_sums, stash


def shard_by_bytes(df: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard (from 0), slot (gapless from 0 within a shard, in id order)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = df.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + overhead).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = stash(prefix_sums(narrow, ["doc_id", "text_crc32", "size"], "size"))
    total = rows.agg(F.sum("size").alias("total"))
    middle = 2 * F.col("before") + F.col("size")
    cut = rows.crossJoin(F.broadcast(total)).withColumn(  # one row
        "shard", F.least(F.expr(f"CAST((2 * before + size) * {int(shards)} div (2 * total) AS INT)"), F.lit(shards - 1))
    )
    firsts = cut.groupBy("shard").agg(F.min("index").alias("first"))
    return cut.join(F.broadcast(firsts), "shard").select(  # one row a shard
        "doc_id", "size", "text_crc32", "shard", (F.col("index") - F.col("first")).alias("slot")
    )
