"""Ranking of functions and orders of report entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcmetrics.functions.paths import components
from srcmetrics.operators.skew import global_position
from srcmetrics.operators.structure import FILE


def function_pool(items: DataFrame) -> DataFrame:
    return items.filter(F.col("is_function"))


def top_functions(items: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` longest functions of each file: length, then name, then source order."""
    order = Window.partitionBy(*FILE).orderBy(F.desc("loc"), "display_name", "ordinal")
    return (
        function_pool(items)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select(*FILE, "path", "rank", "display_name", "loc")
    )


def ordered_files(file_loc: DataFrame) -> DataFrame:
    """Files of each root in component-wise path order, with their position."""
    keyed = file_loc.withColumn("_parts", components(F.col("path")))
    placed = global_position(keyed, ["root"], [F.col("_parts"), F.col("file_id")])
    return placed.drop("_parts").select(*file_loc.columns, "position")


def _ordered(items: DataFrame, categories: tuple[str, ...], *order: Column) -> DataFrame:
    w = Window.partitionBy(*FILE, "category").orderBy(F.desc("loc"), *order, F.col("ordinal"))
    return items.filter(F.col("category").isin(*categories)).withColumn("position", F.row_number().over(w))


NAMED_CATEGORIES = (
    "file_scope_function",
    "test_function",
    "struct",
    "enum",
    "trait",
    "delegate",
    "event",
    "const",
    "static",
)


def ordered_named(items: DataFrame) -> DataFrame:
    return _ordered(items, NAMED_CATEGORIES, F.col("name"))


def ordered_impl_methods(items: DataFrame) -> DataFrame:
    return _ordered(items, ("impl_method",), F.asc_nulls_first("owner_trait"), F.col("owner"), F.col("name"))


def ordered_trait_methods(items: DataFrame) -> DataFrame:
    return _ordered(items, ("trait_method",), F.col("owner"), F.col("name"))


def ordered_impl_blocks(items: DataFrame) -> DataFrame:
    return _ordered(items, ("impl_block",), F.asc_nulls_first("owner_trait"), F.col("name"))
