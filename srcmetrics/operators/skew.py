"""Ways to join and to number rows when one key may hold a third of them."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_BYTES = 32 * 1024 * 1024
#: Keys that the sketch of frequent keys names at most, and keys that it keeps track of.
HEAVY_KEYS, TRACKED = 256, 16384


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master == "local" or context.master.startswith("local["):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="srcmetrics-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def shared_folder(spark: SparkSession) -> str:
    """The URI of a new folder below the one for checkpoints, which all executors share."""
    _ensure_checkpoint_dir(spark)
    base = re.sub(r"^(?:file:)?/+", "file:///", spark.sparkContext.getCheckpointDir())
    return f"{base}/{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared folder, so lost executors lose no result."""
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def heavy_keys(rows: DataFrame, keys: Sequence[str], tasks: int | None = None) -> dict[int, int]:
    """The hashes of keys that hold more rows than a task should have, and over how many tasks
    each is to be spread. A sketch of frequent items counts the keys where the rows are; it
    misses none with more than a few in TRACKED of all rows."""
    tasks = tasks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sketch = F.expr(f"approx_top_k(_h, {HEAVY_KEYS}, {TRACKED})").alias("top")
    found = rows.select(F.xxhash64(*keys).alias("_h")).agg(sketch, F.count("*").alias("n")).first()
    share = max(1, found["n"] // tasks)
    return {r["item"]: -(-r["count"] // share) for r in found["top"] or [] if r["count"] > share}


def skewed_join(
    large: DataFrame, small: DataFrame, keys: Sequence[str], spread_by: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join that spreads the heavy keys of ``large``, and only these, over as many tasks
    as their rows need; only their rows of ``small`` are repeated. ``small`` holds a key at
    most once."""
    heavy = heavy_keys(large, keys)
    if not heavy:
        return large.join(small, list(keys), how)
    pairs = [F.lit(v) for pair in heavy.items() for v in pair]
    salts = F.coalesce(F.try_element_at(F.create_map(*pairs), F.xxhash64(*keys)), F.lit(1))
    left = large.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), salts).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def broadcast_sized(small: DataFrame) -> bool:
    """Whether a checkpointed side, measured, is within the bound for a broadcast."""
    size = small.agg(F.sum(F.length(F.to_json(F.struct("*"))) + 32)).first()[0] or 0
    return size <= BROADCAST_BYTES


def sized_join(
    large: DataFrame, small: DataFrame, keys: Sequence[str], spread_by: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Broadcasts ``small`` if its measured size is within bounds. Beyond them the heavy keys
    of ``large`` are spread, unless ``spread_by`` is part of the key: then no key is hot."""
    small = checkpointed(small)
    if broadcast_sized(small):
        return large.join(F.broadcast(small), list(keys), how)
    if set(spread_by) <= set(keys):
        return large.join(small, list(keys), how)
    return skewed_join(large, small, keys, spread_by, how)


def global_position(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "position"
) -> DataFrame:
    """1-based position within ``group`` without bringing a group into one task.

    Rows are range-partitioned by group and order; each slice numbers its own
    rows and adds the row counts of the slices before it. The slices are fixed by
    a checkpoint, because range bounds are sampled anew in every run.
    """
    ranged = df.repartitionByRange(*[F.col(g) for g in group], *order)
    ranged = checkpointed(ranged.withColumn("_slice", F.spark_partition_id()))
    before = (
        Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        ranged.groupBy(*group, "_slice")
        .count()
        .select(*group, "_slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    )
    own = Window.partitionBy(*group, "_slice").orderBy(*order)
    return (
        ranged.withColumn("_own", F.row_number().over(own))
        .join(offsets, [*group, "_slice"])
        .withColumn(name, (F.col("_before") + F.col("_own")).cast("bigint"))
        .drop("_slice", "_before", "_own")
    )
