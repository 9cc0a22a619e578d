"""Aggregates: totals per root and the nested summary of each file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcmetrics.operators.structure import FILE

# Category and the report field that lists it.
NAMED_FIELDS = {
    "file_scope_function": "file_scope_functions",
    "test_function": "test_functions",
    "struct": "structs",
    "enum": "enums",
    "trait": "traits",
    "delegate": "delegates",
    "event": "events",
    "const": "consts",
    "static": "statics",
}


def totals(file_loc: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Files and lines per root; roots without files show 0 when given."""
    found = file_loc.groupBy("root").agg(
        F.count("*").alias("files"), F.sum("total_loc").cast("bigint").alias("total_loc")
    )
    if roots is None:
        return found
    return (
        roots.select("root")
        .distinct()
        .join(found, "root", "left")
        .select(
            "root",
            F.coalesce("files", F.lit(0)).cast("bigint").alias("files"),
            F.coalesce("total_loc", F.lit(0)).cast("bigint").alias("total_loc"),
        )
    )


def _listed(category: str, *fields: Column) -> Column:
    """Rows of a category in source order."""
    row = F.when(F.col("category") == category, F.struct("ordinal", F.struct(*fields).alias("v")))
    return F.transform(F.sort_array(F.collect_list(row)), lambda r: r["v"])


def file_summary(file_loc: DataFrame, items: DataFrame, top: DataFrame) -> DataFrame:
    """One row per file with its total and its 13 lists. A list holds what one
    source file holds, so its size is bounded by that of an input row."""
    named = [F.col("loc"), F.col("name")]
    lists = items.groupBy(*FILE).agg(
        *[_listed(c, *named).alias(field) for c, field in NAMED_FIELDS.items()],
        _listed(
            "impl_method",
            F.col("owner").alias("impl_target"),
            F.col("loc"),
            F.col("name").alias("method_name"),
            F.col("owner_trait").alias("trait_name"),
        ).alias("impl_methods"),
        _listed(
            "trait_method", F.col("loc"), F.col("name").alias("method_name"), F.col("owner").alias("trait_name")
        ).alias("trait_methods"),
        _listed(
            "impl_block", F.col("name").alias("impl_target"), F.col("loc"), F.col("owner_trait").alias("trait_name")
        ).alias("impl_blocks"),
    )
    best = top.groupBy(*FILE).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("rank", F.struct("loc", F.col("display_name").alias("name")).alias("v")))),
            lambda r: r["v"],
        ).alias("top_functions")
    )
    fields = ["top_functions", *NAMED_FIELDS.values(), "impl_methods", "trait_methods", "impl_blocks"]
    joined = file_loc.join(lists, FILE, "left").join(best, FILE, "left")
    return joined.select(
        *file_loc.columns, *[F.coalesce(F.col(f), F.array().cast(joined.schema[f].dataType)).alias(f) for f in fields]
    )
