"""Which files a scan looks at. All filters read ``path`` only and are narrow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcmetrics.functions import paths as p
from srcmetrics.options import ScanOptions


def with_language(files: DataFrame) -> DataFrame:
    return files.withColumn("language", p.language_of(F.col("path")))


def generated_filter(files: DataFrame) -> DataFrame:
    """Drops build-tool output; needs the ``language`` column."""
    generated = F.coalesce(p.is_generated(F.col("path"), F.col("language")), F.lit(False))
    return files.filter(~generated)


def exclude_prefixes(files: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """Drops files under any prefix, component by component; a null path is under none."""
    clean = sorted(
        {
            "/".join(c for c in x.split("/") if c not in ("", "."))
            for x in map(str.strip, prefixes)
            if not x.startswith(("/", "./")) and x != "."
        }
        - {""}
    )
    if not clean:
        return files
    parts = p.components(F.col("path"))
    ancestors = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
    )
    covered = (F.size(parts) > 0) & F.exists(ancestors, lambda a: a.isin(clean))
    return files.filter(~F.coalesce(covered, F.lit(False)))


def exclude_regex(files: DataFrame, patterns: Sequence[str]) -> DataFrame:
    return files.filter(~p.matches_any(F.col("path"), patterns))


def include_regex(files: DataFrame, patterns: Sequence[str]) -> DataFrame:
    return files.filter(p.matches_any(F.col("path"), patterns)) if patterns else files


def select_files(files: DataFrame, options: ScanOptions) -> DataFrame:
    """Files of a language, minus generated and excluded, of those included."""
    if "language" not in files.columns:
        files = with_language(files)
    files = files.filter(F.col("language").isNotNull())
    if options.language is not None:
        files = files.filter(F.col("language") == options.language)
    return (
        files.transform(generated_filter)
        .transform(exclude_prefixes, options.exclude)
        .transform(exclude_regex, options.exclude_regex)
        .transform(include_regex, options.include_regex)
    )
