"""Whole scans: from a table of files to tables and reports."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcmetrics.functions.paths import root_label
from srcmetrics.operators.csharp_items import csharp_items
from srcmetrics.operators.detect import detect_language
from srcmetrics.operators.ignore import apply_ignore_rules, ignore_rules
from srcmetrics.operators.offenders import offender_items, offending_files, offending_functions
from srcmetrics.operators.rank import top_functions
from srcmetrics.operators.report import json_report, summary_text
from srcmetrics.operators.rust_items import rust_items
from srcmetrics.operators.select import select_files, with_language
from srcmetrics.operators.skew import broadcast_sized, checkpointed, sized_join
from srcmetrics.operators.structure import FILE, scan_status
from srcmetrics.operators.summary import file_summary, totals
from srcmetrics.operators.tree import tree_report
from srcmetrics.options import ScanOptions


def source_rows(files: DataFrame, language: str | None = None) -> DataFrame:
    """Items, and one ``file`` row with the total and status of each file, in one pass
    over the text of a language, or of both. Keep the table partitioned by ``language``
    and each byte is read once."""
    scans = {"rust": rust_items, "csharp": csharp_items}
    wanted = [language] if language else list(scans)
    rows = [scans[x](files.filter(F.col("language") == x), with_files=True) for x in wanted]
    return reduce(DataFrame.unionByName, rows)


def source_items(files: DataFrame) -> DataFrame:
    return source_rows(files).filter(F.col("category") != "file").drop("status")


def source_status(files: DataFrame, mode: str = "permissive") -> DataFrame:
    rust = scan_status(files.filter(F.col("language") == "rust"), "rust", mode)
    return rust.unionByName(scan_status(files.filter(F.col("language") == "csharp"), "csharp", mode))


@dataclass(frozen=True)
class Scan:
    """Result tables of one scan. ``items``, ``file_loc`` and ``status`` come from one
    checkpointed pass over the text; the rest is lazy. ``status`` has every file that was
    scanned: of those that are not ``ok``, definitions may be missing."""

    options: ScanOptions
    roots: DataFrame  # root, label, kind, uri, language, status
    status: DataFrame  # root, file_id, path, status
    file_loc: DataFrame
    items: DataFrame
    top: DataFrame

    @property
    def totals(self) -> DataFrame:
        return totals(self.file_loc, self.roots)

    @property
    def summary(self) -> DataFrame:
        return file_summary(self.file_loc, self.items, self.top)

    def report(self) -> DataFrame:
        """``(root, line_no, text)`` in the format asked for."""
        known = self.roots.filter(F.col("status") == "ok")
        if self.options.output_format == "json":
            return json_report(self.summary, known, self.options)
        texts = summary_text(self.file_loc, self.top)
        return tree_report(texts, known, filtered=self.options.offenders is not None)


def _root_details(chosen: DataFrame, given: DataFrame | None, requested: str | None) -> DataFrame:
    """Every root that is given or has files. A root without files has the language asked
    for; without one it is ambiguous."""
    found = {"label": root_label(F.col("root")), "kind": F.lit("directory"), "uri": F.col("root")}
    if given is None:
        return chosen.withColumns(found)
    both = given.join(chosen, "root", "full_outer")
    both = both.withColumns({k: F.coalesce(k, v) for k, v in found.items()})
    if requested is not None:
        both = both.withColumn("language", F.coalesce("language", F.lit(requested)))
    known = F.when(F.col("language").isNotNull(), "ok").otherwise("ambiguous")
    return both.withColumn("status", F.coalesce("status", known))


def _chosen_files(paths: DataFrame, rules: DataFrame, options: ScanOptions) -> tuple[DataFrame, DataFrame]:
    """(root, file_id) of the files to scan and the language of each root, from paths alone.

    Own ignore rules hold before the language is told, as the files they rule out are no
    part of the root."""
    own = apply_ignore_rules(paths, rules.filter(F.col("source") == ".ignore"))
    chosen = checkpointed(detect_language(own, options.language, options.mode))
    kept = select_files(with_language(paths), options)
    if options.language is None:
        known = chosen.filter(F.col("status") == "ok").select("root", "language")
        kept = sized_join(kept, known, ["root", "language"], ["file_id"])
    return apply_ignore_rules(kept, rules).select(*FILE), chosen


def scan(files: DataFrame, options: ScanOptions | None = None, roots: DataFrame | None = None) -> Scan:
    """Scans every root of ``source_files`` in its own language.

    ``roots`` may add ``root, label, kind, uri``, also for roots without files.

    Which files are scanned is told by paths. The text meets that choice where it is read
    only if the choice can be broadcast; else every file that its path and options admit is
    cut, and the choice meets the few short rows that come of it. Text is in no shuffle."""
    options = (options or ScanOptions()).check_patterns(files.sparkSession)
    rules = checkpointed(ignore_rules(files, require_git=True, gitignore=options.ignore_rules))
    keys, chosen = _chosen_files(files.select(*FILE, "path"), rules, options)
    keys = checkpointed(keys)
    early = broadcast_sized(keys)

    def admitted(table: DataFrame) -> DataFrame:
        return table.join(F.broadcast(keys) if early else keys, FILE, "left_semi")

    texts = select_files(with_language(files), options)
    texts = admitted(texts) if early else texts
    rows = source_rows(texts, options.language)
    rows = checkpointed(rows if early else admitted(rows))  # small next to the text; read several times
    scanned = rows.filter(F.col("category") == "file")
    if options.mode == "failfast":
        text = F.concat(F.lit("unable to parse source file "), F.col("path"))
        failed = F.when(F.col("status") != "ok", F.raise_error(text).cast("string"))
        scanned.select(failed.alias("failed")).agg(F.count("failed")).collect()
    status = scanned.select("root", "file_id", "path", "status")
    sizes = scanned.select("root", "file_id", "path", "language", F.col("loc").alias("total_loc"))
    items = rows.filter(F.col("category") != "file").drop("status")
    top = top_functions(items, options.top)
    if options.offenders is not None:
        limits = options.offenders
        sizes = offending_files(sizes, items, limits.max_loc_per_file, limits.max_loc_per_fn)
        items = offender_items(items, sizes, limits.max_loc_per_fn)
        top = offending_functions(top, limits.max_loc_per_fn)
    return Scan(options, _root_details(chosen, roots, options.language), status, sizes, items, top)
