"""Balanced contiguous shards from global prefix sums of byte sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcmetrics.llm.store import stored

#: Bytes that every row counts besides its text.
ROW_BYTES = 16

def byte_size(text: Column) -> Column:
    """UTF-8 bytes of a text plus ROW_BYTES; a null text has no bytes of its own."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + F.lit(ROW_BYTES)

def prefix_sums(rows: DataFrame, order: Sequence[str | Column], size: str) -> DataFrame:
    """Adds ``before`` (sum of ``size`` of all rows ahead in ``order``), ``position`` (from
    0) and ``total``.

    Rows are dealt to partitions by ranges of the order and stored; each partition's totals
    are summed into offsets, one row per partition; only a partition's own rows are summed
    row by row. No task sees more than one range. Rows equal in all of ``order`` are
    interchangeable."""
    ranged = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    ranged = stored(ranged)
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_part")
        .agg(F.sum(size).alias("_bytes"), F.count("*").alias("_rows"))
        .select(
            "_part",
            F.coalesce(F.sum("_bytes").over(ahead), F.lit(0)).alias("_bytes_before"),
            F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_rows_before"),
            F.sum("_bytes").over(Window.partitionBy()).alias("total"),
        )
    )
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.withColumn("_own", F.coalesce(F.sum(size).over(own), F.lit(0)))
        .withColumn("_ahead", F.count("*").over(own))
        .join(F.broadcast(offsets), "_part")  # one row per partition
        .withColumn("before", F.col("_bytes_before") + F.col("_own"))
        .withColumn("position", F.col("_rows_before") + F.col("_ahead"))
        .drop("_part", "_own", "_ahead", "_bytes_before", "_rows_before")
    )

def shards(
    rows: DataFrame, n_shards: int, order: Sequence[str | Column], size: str = "size"
) -> DataFrame:
    """Adds ``shard`` (0 to ``n_shards`` - 1, ascending in ``order``) and ``slot`` (from 0
    within the shard, without gaps).

    A row goes to the shard in which the middle of its bytes falls when all bytes are cut
    into ``n_shards`` equal parts, so a shard differs from an equal part by less than one
    row at either end. Nulls in ``order`` come first; an empty table gives no rows."""
    summed = prefix_sums(rows, order, size)
    middle = F.expr(f"(2 * before + {size}) * {n_shards}L div (2 * total)")
    placed = summed.withColumn("shard", F.least(F.lit(n_shards - 1), middle).cast("int"))
    placed = stored(placed.drop("before", "total"))
    first = placed.groupBy("shard").agg(F.min("position").alias("_first"))
    return (
        placed.join(F.broadcast(first), "shard")  # one row per shard
        .withColumn("slot", F.col("position") - F.col("_first"))
        .drop("_first", "position")
    )

def shard_documents(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of ``docs``.

    Law ``bytes``: contiguous in doc_id (null first; repeated ids by digest and size) and near
    equal in bytes. A null text has size ROW_BYTES and a null digest. The texts are reduced to
    size and digest where they are read and take part in no shuffle."""
    narrow = docs.select(
        "doc_id",
        byte_size(F.col("text")).alias("size"),
        F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"),
    )
    placed = shards(narrow, n_shards, ["doc_id", "text_crc32", "size"])
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
