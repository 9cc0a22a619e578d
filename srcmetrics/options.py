"""Job parameters, checked on the driver before any job starts."""

from __future__ import annotations

from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

LANGUAGES = ("rust", "csharp")
FORMATS = ("tree", "json")


@dataclass(frozen=True)
class OffenderLimits:
    """Both limits are needed, each above zero; exceeding means strictly more."""

    max_loc_per_file: int
    max_loc_per_fn: int

    def __post_init__(self) -> None:
        for name in ("max_loc_per_file", "max_loc_per_fn"):
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, int):
                raise ValueError(f"{name} must be a whole number, got {value!r}")
            if value <= 0:
                raise ValueError(f"{name} must be greater than zero")


def _stripped(values) -> tuple[str, ...]:
    return tuple(v.strip() for v in values if v.strip())


@dataclass(frozen=True)
class ScanOptions:
    language: str | None = None  # None: detect per root
    exclude: tuple[str, ...] = ()
    include_regex: tuple[str, ...] = ()
    exclude_regex: tuple[str, ...] = ()
    ignore_rules: bool = False
    output_format: str = "tree"
    offenders: OffenderLimits | None = None
    top: int = 3
    mode: str = "permissive"

    def __post_init__(self) -> None:
        if self.language == "auto":
            object.__setattr__(self, "language", None)
        if self.language is not None and self.language not in LANGUAGES:
            raise ValueError(f"language must be one of {LANGUAGES} or auto, got {self.language!r}")
        if self.output_format not in FORMATS:
            raise ValueError(f"output_format must be one of {FORMATS}, got {self.output_format!r}")
        if self.mode not in ("permissive", "failfast"):
            raise ValueError(f"mode must be permissive or failfast, got {self.mode!r}")
        if self.top <= 0:
            raise ValueError("top must be greater than zero")
        for name in ("exclude", "include_regex", "exclude_regex"):
            object.__setattr__(self, name, _stripped(getattr(self, name)))

    def check_patterns(self, spark: SparkSession) -> "ScanOptions":
        """Lets Spark itself compile every pattern; a bad one names its option."""
        for name, label in (("include_regex", "include-path"), ("exclude_regex", "exclude-path")):
            for pattern in getattr(self, name):
                probe = spark.range(1).select(
                    F.rlike(F.lit(""), F.lit("(?U)" + pattern)).alias("ok")
                )
                try:
                    probe.collect()
                except (PySparkException, Py4JJavaError) as err:
                    raise ValueError(f"invalid {label} regex: {pattern}") from err
        return self
