"""JSON reports and one-line summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcmetrics.functions.paths import components
from srcmetrics.operators.skew import global_position
from srcmetrics.operators.structure import FILE
from srcmetrics.operators.summary import totals
from srcmetrics.options import ScanOptions

_KEEP_NULLS = {"ignoreNullFields": "false"}

# Fields of a file summary in the report, alphabetical as printed.
SUMMARY_FIELDS = (
    "consts",
    "delegates",
    "enums",
    "events",
    "file_scope_functions",
    "impl_blocks",
    "impl_methods",
    "statics",
    "structs",
    "test_functions",
    "top_functions",
    "total_loc",
    "trait_methods",
    "traits",
)
# Fields that break ties between entries of equal length; null sorts first.
_TIES = {
    "impl_methods": ("trait_name", "impl_target", "method_name"),
    "trait_methods": ("trait_name", "method_name"),
    "impl_blocks": ("trait_name", "impl_target"),
}


def _longest_first(field: str) -> Column:
    ties = _TIES.get(field, ("name",))
    keyed = F.transform(
        F.col(field), lambda e: F.struct((-e["loc"]).alias("neg"), *[e[t].alias(t) for t in ties], e.alias("v"))
    )
    return F.transform(F.sort_array(keyed), lambda e: e["v"])


def _summary_struct() -> Column:
    fields = [
        F.col(f) if f == "total_loc" else _longest_first(f).alias(f) for f in SUMMARY_FIELDS
    ]
    return F.struct(*fields)


def json_files(summary: DataFrame) -> DataFrame:
    """One JSON text per file."""
    document = F.struct(F.col("path"), _summary_struct().alias("summary"))
    return summary.select(*FILE, "path", F.to_json(document, _KEEP_NULLS).alias("json"))


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def json_report(
    summary: DataFrame, roots: DataFrame, options: ScanOptions | None = None
) -> DataFrame:
    """The report of each root as text lines ``(root, line_no, text)``; joined in
    order they are one JSON document.

    A root is never gathered into one row: it may hold a third of all files. The
    first and last line come from per-root aggregates, each line between is one
    file. ``roots`` gives ``root, label, kind, uri, language`` of each root.
    """
    options = options or ScanOptions()
    opening = F.to_json(
        F.struct(
            _strings(options.exclude_regex).alias("exclude_path_regexes"),
            _strings(options.exclude).alias("excludes"),
        )
    )
    per_root = roots.join(totals(summary, roots), "root")
    closing = F.to_json(
        F.struct(
            F.lit(options.ignore_rules).alias("git_ignore"),
            _strings(options.include_regex).alias("include_path_regexes"),
            F.col("language"),
            F.struct("kind", "label", F.col("uri").alias("path")).alias("root"),
            F.struct("files", "total_loc").alias("totals"),
        ),
        _KEEP_NULLS,
    )
    first = per_root.select(
        "root",
        F.lit(0).cast("bigint").alias("line_no"),
        F.concat(F.regexp_replace(opening, r"\}\z", ""), F.lit(',"files":[')).alias("text"),
    )
    last = per_root.select(
        "root",
        (F.col("files") + 1).alias("line_no"),
        F.concat(F.lit("],"), F.regexp_replace(closing, r"^\{", "")).alias("text"),
    )
    entries = json_files(summary).withColumn("_parts", components(F.col("path")))
    placed = global_position(entries, ["root"], [F.col("_parts"), F.col("file_id")])
    comma = F.when(F.col("position") > 1, ",").otherwise("")
    body = placed.select("root", F.col("position").alias("line_no"), F.concat(comma, "json").alias("text"))
    return first.unionByName(body).unionByName(last)


def one_line(total_loc: Column, top: Column) -> Column:
    listed = F.transform(top, lambda e: F.concat(e["name"], F.lit(" ("), e["loc"].cast("string"), F.lit(")")))
    named = F.when(F.size(top) > 0, F.array_join(listed, ", ")).otherwise("none")
    return F.concat(total_loc.cast("string"), F.lit(" loc; max fns loc: "), named)


def summary_text(file_loc: DataFrame, top: DataFrame) -> DataFrame:
    """``N loc; max fns loc: a (n), b (m)`` or ``... none`` for each file."""
    best = top.groupBy(*FILE).agg(
        F.sort_array(F.collect_list(F.struct("rank", F.col("display_name").alias("name"), "loc"))).alias("_top")
    )
    none = F.array().cast("array<struct<rank:int,name:string,loc:bigint>>")
    return file_loc.join(best, FILE, "left").select(
        *FILE, "path", one_line(F.col("total_loc"), F.coalesce("_top", none)).alias("text")
    )


def write_report(lines: DataFrame, folder: str) -> None:
    """Writes a report ``(root, line_no, text)`` as text files, one folder a root
    (``root=...``). Its part files, joined by name, are the report: rows are dealt by ranges of
    root and line, so neither a root nor the whole is in one task, and no line is moved twice."""
    ordered = lines.repartitionByRange("root", "line_no").sortWithinPartitions("root", "line_no")
    ordered.select("root", "text").write.partitionBy("root").text(folder)
