"""Structural scan: one row per chunk of source text, with nesting depth.

The text itself never reaches a shuffle. A narrow stage cuts it into chunks and
keeps a few numbers and short names of each; one exchange on the file key
``(root, file_id)`` then serves every window below, because windows on
``(root, file_id)`` and on ``(root, file_id, level)`` are both satisfied by it.
A file is one input row already, so no window group is larger than one file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcmetrics.functions import lexical, nesting
from srcmetrics.functions.text import line_breaks, visible_line_starts

FILE = ["root", "file_id"]
OPENERS = ("{", "(", "[")
CLOSERS = ("}", ")", "]")
TERMS = OPENERS + CLOSERS + (";",)
#: Ends a chunk of a later branch of a condition that does what the first branch does; it is
#: counted in lines and has no part in the structure.
PARALLEL = "#"


def mask_source(files: DataFrame, language: str, fill: str = " ") -> DataFrame:
    """Adds ``masked``: comments and literals blanked, line breaks kept."""
    lexicon = lexical.LEXICONS[language]
    text = nesting.flat_comments(F.col("content")) if language == "rust" else F.col("content")
    pieces = F.regexp_extract_all(text, F.lit(lexicon.token), F.lit(0))
    first = {
        "rust": r"""^(?:"|//|/\*|'(?:\\|[^\\]'))|^#*+"(?=[\s\S])""",
        "csharp": r"""^(?:"|//|/\*|#|'(?:\\|[^\\]')|[@$]++")""",
    }[language]
    blank = F.transform(
        pieces,
        lambda p: F.when(
            F.rlike(p, F.lit(first)), F.regexp_replace(p, r"[^\n]", fill)
        ).otherwise(p),
    )
    return files.withColumn("masked", F.array_join(blank, ""))


def chunks(files: DataFrame, language: str, whole_statements: bool = False) -> DataFrame:
    """One row per chunk; narrow. A line break is put at both ends so that every
    line, also the first, begins after one. Unless ``whole_statements``, a run of
    statements that no definition can be part of is taken into the next chunk, so
    that it costs no row of its own in the shuffle."""
    content = F.col("content")
    # a byte-order mark is no part of a head, but makes its line a visible one, as a comment does
    marked = F.startswith(content, F.lit("\ufeff"))
    unmarked = F.when(marked, F.concat(F.lit("/**/"), F.substring(content, 2, 2**31 - 1))).otherwise(content)
    if language == "rust":
        unmarked = nesting.flat_comments(unmarked)
    text = F.concat(F.lit("\n"), unmarked, F.lit("\n"))
    lexicon = lexical.LEXICONS[language]
    single = F.regexp_extract_all(text, F.lit(lexicon.chunk), F.lit(0))
    merged = F.regexp_extract_all(text, F.lit(lexicon.merged_chunk), F.lit(0))
    if whole_statements:
        pieces = single
    elif language == "csharp":  # statements at the top of a file are measured one by one
        pieces = F.when(F.rlike(text, F.lit(lexical.CS_TYPES_FIRST)), merged).otherwise(single)
    else:
        pieces = merged
    last = F.right("chunk", F.lit(1))
    if language == "csharp":
        branches = F.contains(content, F.lit("#el"))
        cut = files.select(*FILE, "path", pieces.alias("pieces"), branches.alias("branches"))
        cut = cut.withColumn("alone", F.when(F.col("branches"), nesting.parallel_branches(F.col("pieces"))))
        # each chunk takes its own flag along, not the flags of the whole file
        flagged = F.transform("pieces", lambda p, i: F.struct(p.alias("chunk"), F.get("alone", i).alias("alone")))
        cut = cut.select(*FILE, "path", F.posexplode(flagged).alias("pos", "piece"))
        cut = cut.select(*FILE, "path", "pos", F.col("piece.chunk").alias("chunk"), F.col("piece.alone").alias("alone"))
        last = F.when(F.col("alone"), PARALLEL).otherwise(last)
    else:
        cut = files.select(*FILE, "path", F.posexplode(pieces).alias("pos", "chunk"))
    return cut.select(
        *FILE,
        F.when(F.col("pos") == 0, F.col("path")).alias("path"),  # once per file: keeps rows narrow
        "pos",
        "chunk",
        F.when(last.isin(*TERMS, PARALLEL), last).otherwise(F.lit("")).alias("term"),
    )


def unpaired(opener: Column, closer: Column) -> Column:
    """Whether ``closer`` is a closing sign that ``opener``, the sign ahead on its level, does
    not go with."""
    pairs = [(opener == o) & (closer == c) for o, c in zip(OPENERS, CLOSERS, strict=True)]
    return closer.isin(*CLOSERS) & ~F.coalesce(reduce(Column.__or__, pairs), F.lit(False))


def status_of(unclosed_text: Column, unpaired_signs: Column, depth: Column) -> Column:
    """``unterminated`` if a file ends inside a literal or comment, ``unbalanced`` if brackets
    do not pair by kind or some are left open, else ``ok``."""
    return F.when(unclosed_text, "unterminated").when(unpaired_signs | (depth != 0), "unbalanced").otherwise("ok")


def measured(
    chunk_rows: DataFrame, lead_pattern: str, marked: str, head: Column, language: str = "rust"
) -> DataFrame:
    """Replaces the text by counts: visible lines and line breaks begun in the
    chunk, and the same up to the first character after its lead, which is blank where the
    chunk does not match ``marked``. The last chunk of a file tells whether the text ends
    inside a literal or comment. ``head`` is one nullable struct, so that the many rows
    without a head stay short."""
    chunk, nl = F.col("chunk"), F.col("nl")
    # The usual chunk is one line: a break, an indent, a statement.
    one_line = (nl == 1) & F.startswith(chunk, F.lit("\n")) & (F.col("term") != "")
    blank = F.length(chunk) - F.length(F.ltrim(chunk, F.lit(lexical.BLANKS)))
    lead = F.when(F.rlike(chunk, F.lit(marked)), F.length(F.regexp_extract(chunk, lead_pattern, 0))).otherwise(blank)
    to_start = F.substring(chunk, F.lit(1), lead + 1)
    return (
        chunk_rows.withColumn("nl", line_breaks(chunk))
        .withColumn("_to_start", F.when((nl > 0) & ~one_line, to_start).otherwise(F.lit("")))
        .select(
            *FILE,
            "path",
            "pos",
            "term",
            F.when((nl == 0) | one_line, nl).otherwise(visible_line_starts(chunk)).alias("nb"),
            "nl",
            F.when(one_line, 1).otherwise(visible_line_starts(F.col("_to_start"))).alias("nb_lead"),
            F.when(one_line, 1).otherwise(line_breaks(F.col("_to_start"))).alias("nl_lead"),
            F.when(F.col("term") == "", nesting.unterminated(chunk, language)).alias("unclosed"),
            head.alias("head"),
        )
    )


def nested(rows: DataFrame) -> DataFrame:
    """Adds running visible-line count (``cum0`` at the start, ``cum1`` at the end
    of the chunk), line numbers, and ``depth`` after and ``level`` at the chunk."""
    ordered = Window.partitionBy(*FILE).orderBy("pos")
    here = ordered.rowsBetween(Window.unboundedPreceding, 0)
    opener = F.col("term").isin(*OPENERS)
    closer = F.col("term").isin(*CLOSERS)
    step = F.when(opener, 1).when(closer, -1).otherwise(0)
    return (
        rows.withColumns(
            {
                "cum1": F.sum("nb").over(here),
                "end_line": F.sum("nl").over(here).cast("int"),
                "depth": F.sum(step).over(here).cast("int"),
                "path": F.first("path", ignorenulls=True).over(here),
                "after_closer": F.coalesce(F.lag("term").over(ordered).isin(*CLOSERS), F.lit(False)),
            }
        )
        .withColumns(
            {
                "opener": opener,
                "closer": closer,
                "cum0": F.col("cum1") - F.col("nb") + F.col("nb_lead"),
                "start_line": (F.col("end_line") - F.col("nl") + F.col("nl_lead")).cast("int"),
                "level": F.col("depth") - F.when(opener, 1).otherwise(0),
            }
        )
        .drop("nb", "nl", "nb_lead", "nl_lead")
    )


def without_plain_statements(rows: DataFrame) -> DataFrame:
    """Drops what no window needs any more once lines are counted: statements that
    are no head and cannot end one (only a ``;`` right after a closer can)."""
    return rows.filter(F.col("term") != PARALLEL).filter(
        F.col("opener")
        | F.col("closer")
        | F.col("head").isNotNull()
        | F.col("after_closer")
        | (F.col("level") == 0)
        | (F.col("term") == "")  # the last row of each file
    )


def with_block_markers(rows: DataFrame) -> DataFrame:
    """Repeats each opener one level deeper, where its content lives, so that one
    window per ``(file, lvl)`` shows a row both its siblings and its parent."""
    places = F.when(F.col("opener"), F.array("level", F.col("level") + 1)).otherwise(F.array("level"))
    return rows.withColumn("lvl", F.explode(places)).withColumn("marker", F.col("lvl") != F.col("level"))


def level_window() -> Window:
    return Window.partitionBy(*FILE, "lvl").orderBy("pos")


def after_attribute(rows: DataFrame, opens: Column, marked: Column) -> DataFrame:
    """Rows of ``with_block_markers`` whose ``cum0`` and ``start_line`` are those of the
    attribute ahead, if that was followed as structure. ``opens`` tells the rows that begin such
    an attribute, ``marked`` is kept with it as ``attribute.marked``."""
    w = level_window()
    at_level = ~F.col("marker")
    place = F.struct("cum0", "start_line", marked.alias("marked"))
    none = F.lit(None).cast("struct<cum0:bigint,start_line:int,marked:boolean>")
    mark = F.when(at_level & opens, F.struct(place.alias("a"))).when(at_level & ~F.col("closer"), F.struct(none.alias("a")))
    ahead = F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))["a"]
    return rows.withColumn("attribute", F.when(at_level & ~F.col("closer"), ahead)).withColumns(
        {c: F.coalesce(F.col("attribute")[c], F.col(c)) for c in ("cum0", "start_line")}
    )


def file_window() -> Window:
    return Window.partitionBy(*FILE).orderBy("pos")


def _events(files: DataFrame, language: str) -> DataFrame:
    rows = measured(chunks(files, language, whole_statements=True), r"^", r"\A", F.lit(None).cast("string"))
    return nested(rows).filter(~F.col("term").isin("", PARALLEL))


def bracket_depth(files: DataFrame, language: str) -> DataFrame:
    """Structural events of each file in order, with running depth and level."""
    return _events(files, language).select(
        *FILE,
        "path",
        F.col("end_line").alias("line_no"),
        F.col("pos").alias("ord"),
        F.col("term").alias("event"),
        "depth",
        "level",
    )


def bracket_pairs(events: DataFrame) -> DataFrame:
    """Openers with the line of their own closer: the next event on the level."""
    w = Window.partitionBy(*FILE, "level").orderBy("ord")
    return (
        events.withColumn("close_line", F.lead("line_no").over(w))
        .filter(F.col("event").isin(*OPENERS))
        .select(*FILE, "path", "line_no", "ord", "event", "level", "close_line")
    )


def scan_status(files: DataFrame, language: str, mode: str = "permissive") -> DataFrame:
    """``ok``, ``unbalanced`` or ``unterminated`` per file, see ``status_of``; ``failfast``
    raises on the first bad one."""
    step = F.when(F.col("term").isin(*OPENERS), 1).when(F.col("term").isin(*CLOSERS), -1).otherwise(0)
    running = F.sum(step).over(file_window().rowsBetween(Window.unboundedPreceding, 0))
    on_level = Window.partitionBy(*FILE, "level").orderBy("pos")
    unclosed = F.when(F.col("term") == "", nesting.unterminated(F.col("chunk"), language))
    per_file = (
        chunks(files, language)
        .select(*FILE, "path", "pos", "term", step.alias("step"), unclosed.alias("unclosed"))
        .filter(~F.col("term").isin(";", PARALLEL) | (F.col("pos") == 0))
        .withColumn("depth", running)
        .withColumn("level", F.col("depth") - F.greatest("step", F.lit(0)))
        .withColumn("ahead", F.lag("term").over(on_level))
        .groupBy(*FILE)
        .agg(
            F.max("path").alias("path"),
            F.max(unpaired(F.col("ahead"), F.col("term"))).alias("unpaired"),
            F.max("unclosed").alias("unclosed"),
            F.sum("step").alias("final"),
        )
    )
    status = status_of(F.col("unclosed"), F.col("unpaired"), F.col("final"))
    if mode == "failfast":
        text = F.concat(F.lit("unable to parse source file "), F.col("path"))
        status = F.when(status != "ok", F.raise_error(text).cast("string")).otherwise(F.lit("ok"))
    return per_file.select(*FILE, "path", status.alias("status"))
