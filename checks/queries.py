"""One query per operator, each over whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import corpora as c
from checks.oracle import FILE_LIMIT, FN_LIMIT, SUMMARY_FIELDS
from srcmetrics.functions import paths as p
from srcmetrics.functions.text import decode_text
from srcmetrics.operators import detect, ignore, lines, offenders, rank, report, select, structure, summary, tree
from srcmetrics.operators.csharp_items import TOP_LEVEL, csharp_items
from srcmetrics.operators.rust_items import block_parent, rust_items
from srcmetrics.operators.skew import checkpointed
from srcmetrics.options import ScanOptions
from srcmetrics.sources.corpus import as_file_root

Query = Callable[[SparkSession, str], DataFrame]
KEY = ["root", "file_id", "path"]
ITEM = [*KEY, "language", "category", "name", "owner", "owner_trait", "display_name", "loc", "is_function"]


def _decode_text(spark: SparkSession, sf: str) -> DataFrame:
    head, tail = F.substring("text", 1, 5), F.expr("substring(text, 6)")
    data = F.concat(F.encode(head, "UTF-8"), F.unhex(F.lit("FF")), F.encode(tail, "UTF-8"))
    return c.documents(spark, sf).select("doc_id", decode_text(data).alias("content"))


def _root_label(spark: SparkSession, sf: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    return pages.select("page_id", p.root_label(F.col("url")).alias("label"))


def _normalise_path(spark: SparkSession, sf: str) -> DataFrame:
    files = c.document_files(spark, sf).withColumn("path", F.translate("path", "/", "\\"))
    return files.select("root", "file_id", p.normalise_separators(F.col("path")).alias("path"))


def _on_documents(step: Callable[[DataFrame], DataFrame], *columns: str) -> Query:
    return lambda spark, sf: c.document_files(spark, sf).transform(step).select(*(columns or KEY))


def _flag(test: Callable) -> Query:
    return _on_documents(lambda f: f.withColumn("generated", test(F.col("path"))), *KEY, "generated")


SELECTION = ScanOptions(exclude=("tests/", " src/core "), exclude_regex=(r"[13]\.",), include_regex=("^src",))


def _on_marked(step: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: step(c.marked_files(spark, sf))


def _ignore(spark: SparkSession, sf: str) -> DataFrame:
    files = c.ruled_files(spark, sf)
    return ignore.apply_ignore_rules(files, ignore.ignore_rules(files)).select(*KEY)


def _span_loc(spark: SparkSession, sf: str) -> DataFrame:
    rows = lines.lines(c.spaced_files(spark, sf))
    spans = rows.select(
        "root",
        "file_id",
        F.col("line_no").alias("start_line"),
        (F.col("line_no") + F.col("file_id") % 5).cast("int").alias("end_line"),
    )
    return lines.span_loc(spans, rows)


def _mask_source(spark: SparkSession, sf: str) -> DataFrame:
    return structure.mask_source(c.quoted_files(spark, sf), "rust").select("root", "file_id", "masked")


def _bracket_depth(spark: SparkSession, sf: str) -> DataFrame:
    return structure.bracket_depth(c.nested_files(spark, sf), "rust").drop("ord")


def _bracket_pairs(spark: SparkSession, sf: str) -> DataFrame:
    events = structure.bracket_depth(c.nested_files(spark, sf), "rust")
    return structure.bracket_pairs(events).drop("ord")


def _block_parent(spark: SparkSession, sf: str) -> DataFrame:
    return block_parent(c.nested_files(spark, sf)).drop("ord", "level")


def _rust(spark: SparkSession, sf: str) -> DataFrame:
    return rust_items(c.rust_files(spark, sf))


def _rust_loc(spark: SparkSession, sf: str) -> DataFrame:
    return lines.file_loc(c.rust_files(spark, sf))


def _rust_where(condition: str) -> Query:
    return lambda spark, sf: _rust(spark, sf).filter(condition).select(*ITEM)


def _csharp_where(condition: str) -> Query:
    return lambda spark, sf: csharp_items(c.csharp_files(spark, sf)).filter(condition).select(*ITEM)


def _csharp_top_level(spark: SparkSession, sf: str) -> DataFrame:
    found = csharp_items(c.statement_files(spark, sf))
    return found.filter(F.col("name") == TOP_LEVEL).select(*KEY, "name", "loc")


def _page_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as files of their hosts: their paths selected and put in order."""
    files = select.exclude_regex(c.page_files(spark, sf).select(*KEY), ["[02468]$"])
    return rank.ordered_files(files).select(*KEY, "position")


def _scan_status(spark: SparkSession, sf: str) -> DataFrame:
    rust = structure.scan_status(c.ended_files(c.rust_files(spark, sf), "rust"), "rust")
    return rust.unionByName(structure.scan_status(c.ended_files(c.csharp_files(spark, sf), "csharp"), "csharp"))


def _top(spark: SparkSession, sf: str) -> DataFrame:
    return rank.top_functions(_rust(spark, sf))


def _offending_files(spark: SparkSession, sf: str, items: DataFrame | None = None) -> DataFrame:
    items = _rust(spark, sf) if items is None else items
    return offenders.offending_files(_rust_loc(spark, sf), items, FILE_LIMIT, FN_LIMIT)


def _offender_items(spark: SparkSession, sf: str) -> DataFrame:
    rows = checkpointed(rust_items(c.rust_files(spark, sf), with_files=True))  # one pass over the text
    items = rows.filter("category <> 'file'")
    sizes = rows.filter("category = 'file'").select(*KEY, F.col("loc").alias("total_loc"))
    kept = offenders.offending_files(sizes, items, FILE_LIMIT, FN_LIMIT)
    return offenders.offender_items(items, kept, FN_LIMIT).select(*ITEM)


def _totals(spark: SparkSession, sf: str) -> DataFrame:
    nations = spark.read.parquet(f"{sf}/nation.parquet")
    roots = (
        c.documents(spark, sf).select(F.col("source").alias("root"))
        .unionByName(nations.select(F.concat(F.lit("empty/"), "n_name").alias("root")))
    )
    return summary.totals(_offending_files(spark, sf), roots)


def _summary(spark: SparkSession, sf: str) -> DataFrame:
    items = checkpointed(_rust(spark, sf))  # read twice below
    return summary.file_summary(_rust_loc(spark, sf), items, rank.top_functions(items))


def _file_summary(spark: SparkSession, sf: str) -> DataFrame:
    nested = _summary(spark, sf)
    text = [
        F.col(f) if f == "total_loc" else F.to_json(F.col(f), {"ignoreNullFields": "false"}).alias(f)
        for f in SUMMARY_FIELDS
    ]
    return nested.select(*KEY, *text)


def _json_report(spark: SparkSession, sf: str) -> DataFrame:
    source = F.col("source")
    roots = c.documents(spark, sf).select(
        source.alias("root"),
        source.alias("label"),
        F.lit("directory").alias("kind"),
        F.concat(F.lit("/repos/"), source).alias("uri"),
        F.lit("rust").alias("language"),
    ).distinct()
    options = ScanOptions(language="rust", exclude=("target", "obj"), exclude_regex=("zzz",))
    return report.json_report(_summary(spark, sf), roots, options)


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return report.summary_text(_rust_loc(spark, sf), _top(spark, sf))


def _tree_empty(spark: SparkSession, sf: str) -> DataFrame:
    files = c.marked_files(spark, sf)
    chosen = detect.detect_language(files)
    kept = detect.scan_detected(files).filter(F.col("language") == "rust")
    roots = chosen.select("root", F.col("root").alias("label"), F.lit("rust").alias("language"))
    return tree.tree_empty(roots, kept)


def queries() -> dict[str, Query]:
    listed = [*ITEM, "position"]
    return {
        "decode_text": _decode_text,
        "read_corpus": lambda spark, sf: c.read_files(spark, sf).select("path", "content"),
        "page_corpus": _page_corpus,
        "file_root": _on_documents(as_file_root, *KEY, "label", "root_kind"),
        "root_label": _root_label,
        "normalise_path": _normalise_path,
        "language_match": _on_documents(select.with_language, *KEY, "language"),
        "generated_dir": _flag(p.in_generated_directory),
        "generated_name": _flag(p.has_generated_name),
        "generated_filter": _on_documents(lambda f: f.transform(select.with_language).transform(select.generated_filter)),
        "exclude_prefix": _on_documents(lambda f: select.exclude_prefixes(f, ["src", " lib/Bin/ ", "", "./obj"])),
        "exclude_regex": _on_documents(lambda f: select.exclude_regex(f, [r"[13]\.", "Debug"])),
        "include_regex": _on_documents(lambda f: select.include_regex(f, ["^src", r"\.md$"])),
        "select_files": _on_documents(lambda f: select.select_files(f, SELECTION), *KEY, "language"),
        "ignore_rules": _ignore,
        "detect_file": _on_documents(detect.detect_file, *KEY, "language", "status"),
        "root_markers": _on_marked(detect.root_markers),
        "language_counts": _on_marked(detect.language_counts),
        "detect_language": _on_marked(detect.detect_language),
        "scan_detected": _on_marked(lambda f: detect.scan_detected(f).select(*KEY, "language")),
        "file_loc": lambda spark, sf: lines.file_loc(c.spaced_files(spark, sf)),
        "lines": lambda spark, sf: lines.lines(c.spaced_files(spark, sf)),
        "span_loc": _span_loc,
        "mask_source": _mask_source,
        "bracket_depth": _bracket_depth,
        "bracket_pairs": _bracket_pairs,
        "block_parent": _block_parent,
        "rust_functions": _rust_where("category IN ('file_scope_function', 'test_function')"),
        "rust_type_defs": _rust_where("category IN ('struct', 'enum')"),
        "rust_consts": _rust_where("category IN ('const', 'static')"),
        "rust_trait_methods": _rust_where("category IN ('trait', 'trait_method')"),
        "rust_impl_blocks": _rust_where("category = 'impl_block'"),
        "rust_impl_methods": _rust_where("category = 'impl_method'"),
        "csharp_types": _csharp_where("category = 'struct' OR (category = 'impl_block' AND owner_trait IS NULL)"),
        "csharp_interfaces": _csharp_where("category = 'trait' OR owner_trait = 'interface'"),
        "csharp_enums": _csharp_where("category = 'enum'"),
        "csharp_delegates": _csharp_where("category = 'delegate'"),
        "csharp_events": _csharp_where("category = 'event'"),
        "csharp_fields": _csharp_where("category IN ('const', 'static')"),
        "csharp_callables": _csharp_where("category IN ('impl_method', 'trait_method') AND NOT contains(name, '.')"),
        "csharp_accessors": _csharp_where("category IN ('impl_method', 'trait_method') AND contains(name, '.')"),
        "csharp_local_functions": _csharp_where("category = 'file_scope_function'"),
        "csharp_top_level": _csharp_top_level,
        "scan_status": _scan_status,
        "top_functions": _top,
        "function_pool": lambda spark, sf: rank.function_pool(_rust(spark, sf)).select(*ITEM),
        "offending_functions": lambda spark, sf: offenders.offending_functions(_rust(spark, sf), FN_LIMIT).select(*ITEM),
        "offending_files": _offending_files,
        "offender_items": _offender_items,
        "totals": _totals,
        "file_summary": _file_summary,
        "ordered_files": _on_documents(lambda f: rank.ordered_files(f.select(*KEY)), *KEY, "position"),
        "ordered_named": lambda spark, sf: rank.ordered_named(_rust(spark, sf)).select(*listed),
        "ordered_impl_methods": lambda spark, sf: rank.ordered_impl_methods(_rust(spark, sf)).select(*listed),
        "ordered_trait_methods": lambda spark, sf: rank.ordered_trait_methods(_rust(spark, sf)).select(*listed),
        "ordered_impl_blocks": lambda spark, sf: rank.ordered_impl_blocks(_rust(spark, sf)).select(*listed),
        "json_files": lambda spark, sf: report.json_files(_summary(spark, sf)),
        "json_report": _json_report,
        "summary_text": _texts,
        "tree_report": lambda spark, sf: tree.tree_report(_texts(spark, sf)),
        "tree_file_root": lambda spark, sf: tree.tree_file_root(_texts(spark, sf)),
        "tree_empty": _tree_empty,
    }
