"""Path predicates. Every one is a plain column expression on a relative,
``/``-separated path, so it can be evaluated before any text is read."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Language name and the extension that marks it.
EXTENSIONS = {"rust": "rs", "csharp": "cs"}

# What marks C# output of build tools.
GENERATED_DIRECTORIES = ("obj", "bin")
GENERATED_SUFFIXES = (
    ".designer.cs",
    ".generated.cs",
    ".g.cs",
    ".g.i.cs",
    ".assemblyinfo.cs",
    ".assemblyattributes.cs",
    ".razor.g.cs",
)
GENERATED_NAMES = ("assemblyinfo.cs", "solutioninfo.cs")
GENERATED_PREFIX = "temporarygeneratedfile_"


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def components(path: Column) -> Column:
    """Path components; empty ones and ``.`` carry no name and are left out."""
    return F.filter(F.split(path, "/"), lambda c: (c != "") & (c != "."))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def root_label(uri: Column) -> Column:
    """Last component of a location; the location itself if it has none."""
    label = F.regexp_extract(uri, r"([^/]+)/*\z", 1)
    return F.when(label == "", uri).otherwise(label)


def normalise_separators(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def language_is(path: Column, language: str) -> Column:
    """Extension match, ASCII case-insensitive; ``.rs`` alone has no extension."""
    return F.rlike(base_name(path), F.lit(rf"(?s)^.+\.(?i:{EXTENSIONS[language]})\z"))


def language_of(path: Column) -> Column:
    out = F.lit(None).cast("string")
    for name in EXTENSIONS:
        out = F.when(language_is(path, name), F.lit(name)).otherwise(out)
    return out


def in_generated_directory(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda c: F.lower(c).isin(*GENERATED_DIRECTORIES))


def has_generated_name(path: Column) -> Column:
    name = F.lower(base_name(path))
    return (
        any_of([F.endswith(name, F.lit(s)) for s in GENERATED_SUFFIXES])
        | name.isin(*GENERATED_NAMES)
        | F.startswith(name, F.lit(GENERATED_PREFIX))
    )


def is_generated(path: Column, language: Column) -> Column:
    """Build-tool output. Only C# has any; Rust files never count as generated."""
    return F.when(
        language == "csharp", in_generated_directory(path) | has_generated_name(path)
    ).otherwise(F.lit(False))


def matches_any(path: Column, patterns: Sequence[str]) -> Column:
    """Unanchored any-of regex search with Unicode character classes."""
    return any_of([F.rlike(path, F.lit("(?U)" + p)) for p in patterns])
