"""The ``items`` table: one row per definition, whatever the language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FUNCTION_CATEGORIES = ("file_scope_function", "impl_method", "trait_method", "test_function")

ITEM_COLUMNS = [
    "root",
    "file_id",
    "path",
    "language",
    "ordinal",
    "category",
    "name",
    "owner",
    "owner_trait",
    "display_name",
    "start_line",
    "end_line",
    "loc",
    "is_function",
]


def text_or_null(col: Column) -> Column:
    return F.when(col != "", col)


def item_projection(language: str, **given: Column) -> list[Column]:
    """Item columns in order; ``given`` supplies what is not already a column."""
    columns = {"language": F.lit(language), **given}
    columns.setdefault("is_function", F.col("category").isin(*FUNCTION_CATEGORIES))
    return [columns.get(c, F.col(c)).alias(c) for c in ITEM_COLUMNS]
