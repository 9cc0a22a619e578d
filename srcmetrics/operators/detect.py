"""Language detection: one aggregation per root, on paths alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcmetrics.functions import paths as p
from srcmetrics.operators.select import with_language
from srcmetrics.operators.skew import sized_join


def _rust_marker(path: Column) -> Column:
    return path == "Cargo.toml"


def _dotnet_marker(path: Column) -> Column:
    return (F.instr(path, "/") == 0) & F.rlike(path, F.lit(r"(?is)^.+\.(?:sln|csproj)\z"))


def _marker_aggregates() -> list[Column]:
    path = F.col("path")
    return [
        F.max(_rust_marker(path)).alias("has_cargo_toml"),
        F.max(_dotnet_marker(path)).alias("has_dotnet_marker"),
    ]


def _count_aggregates() -> list[Column]:
    path = F.col("path")
    csharp = p.language_is(path, "csharp") & ~p.is_generated(path, F.lit("csharp"))
    return [
        F.count_if(p.language_is(path, "rust")).alias("rust_files"),
        F.count_if(csharp).alias("csharp_files"),
    ]


def root_markers(files: DataFrame) -> DataFrame:
    return files.groupBy("root").agg(*_marker_aggregates())


def language_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("root").agg(*_count_aggregates())


def detect_file(files: DataFrame) -> DataFrame:
    """Language of single-file roots; ``status`` tells where none fits."""
    language = p.language_of(F.col("path"))
    return files.select(
        "root",
        "file_id",
        "path",
        language.alias("language"),
        F.when(language.isNull(), "unknown").otherwise("ok").alias("status"),
    )


def detect_language(
    files: DataFrame, requested: str | None = None, mode: str = "permissive"
) -> DataFrame:
    """``(root, language, status)``: a sole marker decides, then the only language
    present, then the majority; otherwise the root is ambiguous."""
    if requested is not None:
        return files.groupBy("root").agg(
            F.lit(requested).alias("language"), F.lit("ok").alias("status")
        )
    seen = files.groupBy("root").agg(*_marker_aggregates(), *_count_aggregates())
    cargo, dotnet = F.col("has_cargo_toml"), F.col("has_dotnet_marker")
    rust, csharp = F.col("rust_files"), F.col("csharp_files")
    language = (
        F.when(cargo & ~dotnet, "rust")
        .when(dotnet & ~cargo, "csharp")
        .when(rust > csharp, "rust")  # also covers: the only language present
        .when(csharp > rust, "csharp")
    )
    status = F.when(language.isNull(), F.lit("ambiguous")).otherwise(F.lit("ok"))
    if mode == "failfast":
        text = F.concat(
            F.lit("unable to auto-detect language for "), F.col("root"), F.lit("; pass a language explicitly")
        )
        status = F.when(language.isNull(), F.raise_error(text).cast("string")).otherwise(F.lit("ok"))
    return seen.select("root", language.alias("language"), status.alias("status"))


def scan_detected(files: DataFrame, mode: str = "permissive") -> DataFrame:
    """Files written in the language their root was detected as."""
    chosen = detect_language(files, mode=mode).filter(F.col("status") == "ok").select("root", "language")
    own = with_language(files).filter(F.col("language").isNotNull())
    return sized_join(own, chosen, ["root", "language"], ["file_id"]).select(*files.columns, "language")
