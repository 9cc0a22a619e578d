"""Line measurement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcmetrics.functions.text import is_nonblank, nonblank_lines, text_lines
from srcmetrics.operators.structure import FILE


def file_loc(files: DataFrame) -> DataFrame:
    """Non-blank lines per file; narrow."""
    extra = [c for c in ("language",) if c in files.columns]
    return files.select(*FILE, "path", *extra, nonblank_lines(F.col("content")).alias("total_loc"))


def lines(files: DataFrame) -> DataFrame:
    """One row per line, numbered from 1; narrow."""
    return files.select(
        *FILE, "path", F.posexplode(text_lines(F.col("content"))).alias("_at", "line")
    ).select(
        *FILE, "path", (F.col("_at") + 1).alias("line_no"), "line", is_nonblank(F.col("line")).alias("nonblank")
    )


def span_loc(spans: DataFrame, line_rows: DataFrame) -> DataFrame:
    """Non-blank lines of each ``[start_line, end_line]``; spans with none are dropped.

    Span ends are laid between the lines of their file and read off one running
    sum, so there is no range join, and a span past the last line is clamped.
    """
    payload = [c for c in spans.columns if c not in FILE]
    span = F.struct(*payload)
    valid = spans.filter((F.col("start_line") > 0) & (F.col("end_line") > 0))
    edges = valid.select(
        *FILE,
        span.alias("span"),
        F.explode(
            F.array(
                F.struct(F.col("start_line").alias("at"), F.lit(0).alias("phase")),
                F.struct(F.col("end_line").alias("at"), F.lit(2).alias("phase")),
            )
        ).alias("edge"),
    ).select(*FILE, "span", "edge.at", "edge.phase", F.lit(0).alias("nb"))
    counted = line_rows.select(
        *FILE,
        F.col("line_no").alias("at"),
        F.lit(1).alias("phase"),
        F.when(F.col("nonblank"), 1).otherwise(0).alias("nb"),
    )
    running = Window.partitionBy(*FILE).orderBy("at", "phase").rowsBetween(Window.unboundedPreceding, 0)
    signed = F.when(F.col("phase") == 2, F.col("seen")).otherwise(-F.col("seen"))
    return (
        edges.unionByName(counted, allowMissingColumns=True)
        .withColumn("seen", F.sum("nb").over(running))
        .filter(F.col("span").isNotNull())
        .groupBy(*FILE, "span")
        .agg(F.sum(signed).alias("sum"), (F.count("*") / 2).cast("int").alias("copies"))
        .withColumn("loc", (F.col("sum") / F.col("copies")).cast("bigint"))
        .filter(F.col("loc") > 0)
        .withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
        .select(*FILE, "span.*", "loc")
    )
