"""Tables kept in the folder that all executors share, and measured small sides."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a measured side is broadcast.
BROADCAST_BYTES = 16 * 1024 * 1024
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; only a local session without that
    setting gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back: the lineage ends there,
    and a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within, what a query shuffled is removed from the disks when the query ends, not when the
    driver happens to collect its garbage. For tables that are stored and read back."""
    kept = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, kept) if kept is not None else spark.conf.unset(_CLEANUP)


def bounded(df: DataFrame, row_bytes: int) -> DataFrame:
    """Marks a stored table for broadcast if its measured rows are within bounds; otherwise
    the join is left to Spark, which shuffles and splits skewed keys."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the Python workers of the session, once, so that they need not
    have it installed."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        target = f"{tempfile.mkdtemp(prefix='srcmetrics-')}/srcmetrics.zip"
        with zipfile.ZipFile(target, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        context.addPyFile(target)
        _shipped.add(context.applicationId)
    return spark
