"""Files and functions over their size limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcmetrics.operators.structure import FILE


def offending_functions(functions: DataFrame, max_loc_per_fn: int) -> DataFrame:
    """Function rows over the limit; takes ``items`` or a top-functions table."""
    over = F.col("loc") > max_loc_per_fn
    if "is_function" in functions.columns:
        over = over & F.col("is_function")
    return functions.filter(over)


def offending_files(
    file_loc: DataFrame, items: DataFrame, max_loc_per_file: int, max_loc_per_fn: int
) -> DataFrame:
    """Files over the limit, or with a function over the limit.

    One left join on the unique file key: the function side is first reduced to
    one small row per file.
    """
    worst = (
        offending_functions(items, max_loc_per_fn)
        .groupBy(*FILE)
        .agg(F.lit(True).alias("_has_offender"))
    )
    return (
        file_loc.join(worst, FILE, "left")
        .filter((F.col("total_loc") > max_loc_per_file) | F.col("_has_offender"))
        .select(*file_loc.columns)
    )


def offender_items(items: DataFrame, files: DataFrame, max_loc_per_fn: int) -> DataFrame:
    """Detail of retained files: functions over the limit, all other rows."""
    kept = items.filter(~F.col("is_function") | (F.col("loc") > max_loc_per_fn))
    return kept.join(files.select(*FILE), FILE, "left_semi").select(*items.columns)
