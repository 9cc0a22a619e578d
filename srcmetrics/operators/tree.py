"""Tree reports: ``(root, line_no, text)``, one row per printed line.

Every step is keyed so that neither a root nor a directory that holds a third of
all files becomes one task: last children are found by a partial ``max``, indents
are worked out once per directory, both come back to the nodes in one join whose
heavy keys are spread, and line numbers come from a range partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcmetrics.functions.paths import components
from srcmetrics.operators.skew import checkpointed, global_position, sized_join
from srcmetrics.operators.structure import FILE

# The drawing strings and messages of the report.
BRANCH, LAST_BRANCH = "├──", "└──"
PIPE, SPACE = "│   ", "    "
NONE_EXCEEDED = "no files exceeded configured LOC limits"
NONE_MATCHED = "no files matched language "


def _joined(parts: Column) -> Column:
    return F.array_join(parts, "/")


def _head(parts: Column, n: Column) -> Column:
    return F.slice(parts, F.lit(1), n)


def _nodes(texts: DataFrame) -> DataFrame:
    """Directories and files: ``root, parent, is_file, name, file_id, key, text``.

    ``key`` orders nodes as printed: at each depth directories before files."""
    parts = components(F.col("path"))
    files = texts.withColumn("parts", parts).filter(F.size("parts") > 0)
    depth = F.size("parts")
    part = F.struct  # (is_file, name) per component

    def key(parts_: Column, n_dirs: Column, file_name: Column | None, file_id: Column) -> Column:
        dirs = F.transform(_head(parts_, n_dirs), lambda c: part(F.lit(0).alias("f"), c.alias("n"), F.lit(0).cast("bigint").alias("i")))
        if file_name is None:
            return dirs
        return F.concat(dirs, F.array(part(F.lit(1).alias("f"), file_name.alias("n"), file_id.alias("i"))))

    file_nodes = files.select(
        "root",
        _joined(_head(F.col("parts"), depth - 1)).alias("parent"),
        F.lit(1).alias("is_file"),
        F.element_at("parts", -1).alias("name"),
        "file_id",
        key(F.col("parts"), depth - 1, F.element_at("parts", -1), F.col("file_id")).alias("key"),
        "text",
    )
    # the ancestors of the directories that hold files, each directory once
    holding = files.filter(depth > 1).select("root", _joined(_head(F.col("parts"), depth - 1)).alias("dir")).distinct()
    above = F.transform(F.sequence(F.lit(1), F.size(F.split("dir", "/"))), lambda n: F.call_function("substring_index", F.col("dir"), F.lit("/"), n))
    dirs = (
        holding.select("root", F.explode(above).alias("dir"))
        .distinct()
        .select("root", F.split("dir", "/").alias("parts"))
        .select(
            "root",
            _joined(_head(F.col("parts"), F.size("parts") - 1)).alias("parent"),
            F.lit(0).alias("is_file"),
            F.element_at("parts", -1).alias("name"),
            F.lit(0).cast("bigint").alias("file_id"),
            key(F.col("parts"), F.size("parts"), None, F.lit(0)).alias("key"),
            F.lit(None).cast("string").alias("text"),
        )
    )
    return file_nodes.unionByName(dirs)


def _indents(dirs: DataFrame) -> DataFrame:
    """``root, parent, indent``: what is drawn before the children of a directory."""
    own = F.concat_ws("/", F.when(F.col("parent") != "", F.col("parent")), F.col("name"))
    listed = checkpointed(dirs.select("root", own.alias("dir"), "is_last"))
    ancestors = F.transform(
        F.sequence(F.lit(1), F.size(F.split("dir", "/"))),
        lambda n: F.struct(n.alias("n"), F.call_function("substring_index", F.col("dir"), F.lit("/"), n).alias("anc")),
    )
    steps = listed.select("root", "dir", F.explode(ancestors).alias("a")).select("root", "dir", "a.n", "a.anc")
    flags = listed.select("root", F.col("dir").alias("anc"), "is_last")
    return (
        sized_join(steps, flags, ["root", "anc"], ["dir"])
        .groupBy("root", "dir")
        .agg(F.sort_array(F.collect_list(F.struct("n", "is_last"))).alias("chain"))
        .select(
            "root",
            F.col("dir").alias("parent"),
            F.array_join(
                F.transform("chain", lambda c: F.when(c["is_last"], SPACE).otherwise(PIPE)), ""
            ).alias("indent"),
        )
    )


def tree_report(
    texts: DataFrame, roots: DataFrame | None = None, filtered: bool = False
) -> DataFrame:
    """Tree of each directory root. ``texts`` is ``summary_text``; ``roots`` gives
    ``root, label, language`` and adds the message of roots without files."""
    nodes = checkpointed(_nodes(texts))  # short rows, read three times
    # Which child of a directory comes last: partial aggregation, no window on it.
    child = F.struct("is_file", "name", "file_id")
    last = checkpointed(nodes.groupBy("root", "parent").agg(F.max(child).alias("last")))
    dirs = sized_join(nodes.filter(F.col("is_file") == 0), last, ["root", "parent"], ["name"])
    indents = _indents(dirs.withColumn("is_last", child == F.col("last")))
    about = last.join(indents, ["root", "parent"], "left")
    drawn = sized_join(nodes, about, ["root", "parent"], ["name", "file_id"]).withColumn("is_last", child == F.col("last"))
    placed = global_position(
        drawn.select("root", "key", "name", "is_file", "is_last", "text", F.coalesce("indent", F.lit("")).alias("indent")),
        ["root"],
        [F.col("key")],
    )
    branch = F.when(F.col("is_last"), LAST_BRANCH).otherwise(BRANCH)
    label = F.when(F.col("is_file") == 1, F.concat("name", F.lit(" ("), "text", F.lit(")"))).otherwise(
        F.concat("name", F.lit("/"))
    )
    body = placed.select(
        "root", F.col("position").alias("line_no"), F.concat("indent", branch, F.lit(" "), label).alias("text")
    )
    given = roots if roots is not None else texts.select("root").distinct().withColumn("label", F.col("root"))
    top = given.select(
        "root", F.lit(0).cast("bigint").alias("line_no"), F.concat(F.lit(". "), "label", F.lit("/")).alias("text")
    )
    out = top.unionByName(body)
    return out.unionByName(_empty_directories(roots, texts, filtered)) if roots is not None else out


def _message(filtered: bool) -> Column:
    return F.lit(NONE_EXCEEDED) if filtered else F.concat(F.lit(NONE_MATCHED), F.col("language"))


def _empty_directories(roots: DataFrame, texts: DataFrame, filtered: bool) -> DataFrame:
    filled = texts.select("root").distinct()
    return roots.join(filled, "root", "left_anti").select(
        "root",
        F.lit(1).cast("bigint").alias("line_no"),
        F.concat(F.lit(LAST_BRANCH + " "), _message(filtered)).alias("text"),
    )


def tree_empty(roots: DataFrame, texts: DataFrame, filtered: bool = False) -> DataFrame:
    """Both lines of the report of each directory root without files."""
    empty = roots.join(texts.select("root").distinct(), "root", "left_anti")
    top = empty.select(
        "root", F.lit(0).cast("bigint").alias("line_no"), F.concat(F.lit(". "), "label", F.lit("/")).alias("text")
    )
    return top.unionByName(_empty_directories(roots, texts, filtered))


def tree_file_root(texts: DataFrame) -> DataFrame:
    """The report of single-file roots: one line each."""
    return texts.select(
        *FILE,
        F.lit(0).cast("bigint").alias("line_no"),
        F.concat(F.lit(". "), F.element_at(components(F.col("path")), -1), F.lit(" ("), "text", F.lit(")")).alias("text"),
    )


def tree_empty_file_root(roots: DataFrame, filtered: bool = False) -> DataFrame:
    """The line of single-file roots whose file was not kept."""
    return roots.select(
        "root",
        F.lit(0).cast("bigint").alias("line_no"),
        F.concat(F.lit(". "), "label", F.lit(" ("), _message(filtered), F.lit(")")).alias("text"),
    )
