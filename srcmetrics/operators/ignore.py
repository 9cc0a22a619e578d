"""Ignore rules from ``.gitignore`` and ``.ignore`` rows of the file table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcmetrics.functions.paths import base_name, components
from srcmetrics.functions.text import text_lines
from srcmetrics.operators.skew import broadcast_sized, checkpointed, sized_join, skewed_join
from srcmetrics.operators.structure import FILE

RULE_FILES = (".gitignore", ".ignore")
#: Rules of a repository as a whole, which any ``.gitignore`` overrides.
EXCLUDE_FILE = ".git/info/exclude"


# A glob in pieces: directories, anything in a name, a character, an escaped one, a class, and
# other text. A class may begin with its own closing sign and hold named classes.
_CLASS = r"\[[!^]?+\]?+(?:\[:\w+:\]|[^\]])*+\]"
_PIECE = rf"(?:^|(?<=/))\*\*/|(?<=/)\*\*$|\*+|\?|\\[\s\S]|{_CLASS}|[^*?\\\[]+|[\s\S]"
_NAMED_CLASSES = ("alnum", "alpha", "blank", "cntrl", "digit", "graph", "lower", "print", "punct", "space", "upper", "xdigit")


def _quoted(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\.+^$|(){}&\[\]*?~#-])", r"\\$1")


def _class_regex(piece: Column) -> Column:
    """A character class of a glob as one of a regex: only ``!``, ranges and named classes
    mean something in it."""
    negated = F.rlike(piece, F.lit(r"^\[[!^]"))
    body = F.regexp_replace(piece, r"^\[[!^]?|\]$", "")
    body = F.regexp_replace(body, r"\[:(\w+):\]", "\u0001$1\u0002")
    body = F.regexp_replace(body, r"([\\\[\]^&])", r"\\$1")
    for name in _NAMED_CLASSES:
        java = "XDigit" if name == "xdigit" else name.capitalize()
        body = F.replace(body, F.lit(f"\u0001{name}\u0002"), F.lit(rf"\p{{{java}}}"))
    return F.concat(F.when(negated, F.lit("[^")).otherwise(F.lit("[")), body, F.lit("]"))


def _glob_regex(glob: Column) -> Column:
    """Regex for one glob, piece by piece."""

    def regex(piece: Column) -> Column:
        return (
            F.when(piece == "**/", "(?:.*/)?")
            .when((piece == "**") & F.endswith(glob, F.lit("/**")), ".+")
            .when(F.startswith(piece, F.lit("*")), "[^/]*")
            .when(piece == "?", "[^/]")
            .when(F.startswith(piece, F.lit("\\")), _quoted(F.substring(piece, 2, 1)))
            .when(F.startswith(piece, F.lit("[")) & (F.length(piece) > 1), _class_regex(piece))
            .otherwise(_quoted(piece))
        )

    return F.array_join(F.transform(F.regexp_extract_all(glob, F.lit(_PIECE), F.lit(0)), regex), "")


def _malformed(glob: Column) -> Column:
    """Globs that no path can match: a class that is not closed or has a range out of order, or
    a lone backslash at the end."""

    def broken(piece: Column) -> Column:
        body = F.regexp_replace(F.regexp_replace(piece, r"^\[[!^]?|\]$", ""), r"\[:\w+:\]", "")
        ranges = F.regexp_extract_all(body, F.lit(r"[\s\S]-[\s\S]"), F.lit(0))
        disordered = F.exists(ranges, lambda r: F.substring(r, 1, 1) > F.substring(r, 3, 1))
        return piece.isin("[", "\\") | (F.startswith(piece, F.lit("[")) & disordered)

    return F.exists(F.regexp_extract_all(glob, F.lit(_PIECE), F.lit(0)), broken)


def ignore_rules(files: DataFrame, require_git: bool = False, gitignore: bool = True) -> DataFrame:
    """One row per rule: ``root, dir, source, ordinal, negated, dir_only, regex``.

    ``regex`` is matched against the path relative to ``dir``. With ``gitignore``
    off only ``.ignore`` files count, else ``.gitignore`` and ``.git/info/exclude``,
    too; ``require_git`` keeps these two of roots that hold a ``.git`` directory
    only. Lines whose glob is malformed are no rules.
    """
    source = base_name(F.col("path"))
    exclude = F.col("path") == EXCLUDE_FILE
    rows = files.filter((source.isin(*RULE_FILES) | exclude) if gitignore else (source == ".ignore"))
    if require_git and gitignore:
        repositories = (
            files.filter(F.startswith("path", F.lit(".git/"))).select("root").distinct().withColumn("_git", F.lit(True))
        )
        repositories = checkpointed(repositories)
        rows = rows.join(F.broadcast(repositories) if broadcast_sized(repositories) else repositories, "root", "left").filter((source == ".ignore") | F.col("_git")).drop("_git")
    rule = rows.select(
        "root",
        F.when(exclude, "").otherwise(F.regexp_replace("path", r"/?[^/]+\z", "")).alias("dir"),
        source.alias("source"),
        F.posexplode(text_lines(F.col("content"))).alias("ordinal", "line"),
    )
    text = F.regexp_replace("line", r"(?<!\\)[ \t]+\z", "")
    rule = rule.withColumn("line", text).filter((F.col("line") != "") & ~F.startswith("line", F.lit("#")))
    negated = F.startswith("line", F.lit("!"))
    bare = F.regexp_replace(F.when(negated, F.substring("line", 2, 1 << 30)).otherwise(F.col("line")), r"^\\([#!])", "$1")
    glob = F.regexp_replace(bare, r"/+\z", "")
    anchored = F.contains(glob, F.lit("/"))
    body = _glob_regex(F.regexp_replace(glob, r"^/+", ""))
    regex = F.concat(F.when(anchored, "^").otherwise("^(?:.*/)?"), body, F.lit(r"\z"))
    return rule.filter((glob != "") & ~_malformed(glob)).select(
        "root", "dir", "source", "ordinal", negated.alias("negated"), F.endswith(bare, F.lit("/")).alias("dir_only"), regex.alias("regex")
    )


def ignored_files(files: DataFrame, rules: DataFrame) -> DataFrame:
    """``root, file_id`` of files ruled out, themselves or by a directory above.

    The rules of one directory are one row with an array, as long as its rule
    file. Only files of roots that have rules are looked at, and a file meets the
    rows of its own ancestors only, by an equi-join: a broadcast as long as the
    directories with rules are few.
    """
    fields = F.struct("ordinal", "negated", "dir_only", "regex")
    per_dir = rules.groupBy("root", "dir").agg(
        *[
            F.sort_array(F.collect_list(F.when(F.col("source") == s, fields))).alias(alias)
            for s, alias in zip((*RULE_FILES, "exclude"), ("git_rules", "own_rules", "repository_rules"))
        ]
    )
    per_dir = checkpointed(per_dir)
    few = broadcast_sized(per_dir)
    if few:
        files = files.join(F.broadcast(per_dir.select("root").distinct()), "root", "left_semi")
    parts = components(F.col("path"))
    depth = F.size("parts")
    above = F.transform(
        F.sequence(F.lit(0), depth - 1),
        lambda n: F.struct(n.alias("d"), F.array_join(F.slice("parts", F.lit(1), n), "/").alias("dir")),
    )
    met = (
        files.select(*FILE, "path", parts.alias("parts"))
        .filter(depth > 0)
        .select(*FILE, "parts", F.explode(above).alias("a"))
        .select(*FILE, "parts", F.col("a.d").alias("d"), F.col("a.dir").alias("dir"))
    )
    keys = ["root", "dir"]
    met = met.join(F.broadcast(per_dir), keys) if few else skewed_join(met, per_dir, keys, ["file_id"])
    # Each path from just below the rule file down to the file itself.
    step = F.explode(F.sequence(F.col("d") + 1, F.size("parts"))).alias("n")
    candidates = met.select("*", step).withColumn(
        "rel", F.array_join(F.slice("parts", F.col("d") + 1, F.col("n") - F.col("d")), "/")
    )
    is_dir = F.col("n") < F.size("parts")

    def verdict(rules_: str) -> Column:
        hit = F.filter(rules_, lambda r: (is_dir | ~r["dir_only"]) & F.rlike(F.col("rel"), r["regex"]))
        return F.when(F.size(hit) > 0, ~F.element_at(hit, -1)["negated"])

    def nearest(column: str) -> Column:
        return F.max_by(column, F.when(F.col(column).isNotNull(), F.col("d")))

    return (
        candidates.select(*FILE, "n", "d", *[verdict(f"{s}_rules").alias(s) for s in ("own", "git", "repository")])
        .groupBy(*FILE, "n")
        .agg(*[nearest(s).alias(s) for s in ("own", "git", "repository")])
        .groupBy(*FILE)
        .agg(F.max(F.coalesce("own", "git", "repository", F.lit(False))).alias("ignored"))
        .filter("ignored")
        .select(*FILE)
    )


def apply_ignore_rules(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Files that no rule rules out; the last match in the nearest rule file wins,
    ``.ignore`` before ``.gitignore`` before ``.git/info/exclude``, and nothing returns from below an ignored
    directory."""
    if rules.isEmpty():
        return files
    return sized_join(files, ignored_files(files.select(*FILE, "path"), rules), FILE, FILE, "left_anti")
