"""Definitions in Rust files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcmetrics.functions import lexical as lx
from srcmetrics.functions.nesting import after_angles
from srcmetrics.operators.items import item_projection, text_or_null
from srcmetrics.operators.structure import (
    FILE,
    OPENERS,
    after_attribute,
    chunks,
    file_window,
    level_window,
    measured,
    nested,
    status_of,
    unpaired,
    with_block_markers,
    without_plain_statements,
)

BLOCK_KINDS = ("fn", "struct", "enum", "trait", "impl")
VALUE_KINDS = ("const", "static")


def spaced_tokens(text: Column) -> Column:
    """Type text with one space between tokens and none inside round or square
    brackets: ``Foo<'a,T>`` reads ``Foo < 'a , T >``."""
    out = F.regexp_replace(text, r"(::|->|=>|\.\.=?|[<>,&*;:=+!?|{}()\[\]-])", " $1 ")
    out = F.regexp_replace(out, r"\s+", " ")
    out = F.regexp_replace(out, r"([(\[]) | ([)\]])", "$1$2")
    return F.trim(out)


HEAD = "struct<kind:string,name:string,trait_path:string,is_test:boolean,pos:int,cum0:bigint,start_line:int>"


def _heads(cut: DataFrame) -> DataFrame:
    """Adds ``kind`` where a chunk begins a definition."""
    chunk, marked = F.col("chunk"), F.col("marked")
    definition = F.when(marked, F.regexp_extract(chunk, lx.RUST_HEAD, 0)).otherwise(F.regexp_extract(chunk, lx.RUST_BARE_HEAD, 0))
    found = cut.withColumn("marked", F.rlike(chunk, F.lit(lx.RUST_MARKED))).withColumn(
        "_head", F.when(F.col("term").isin("{", ";", "(", "["), definition).otherwise(F.lit(""))
    )
    word = F.regexp_extract("_head", r"(\w+)(?:\W+mut\b)?(?:\s|//[^\n]*+|/\*[\s\S]*?\*/)+(?:r#)?\w+\z", 1)
    kind = F.when(F.col("_head") == "", None).when(F.endswith("_head", F.lit("impl")), "impl").otherwise(word)
    found = found.withColumn("kind", kind)
    typed = F.when(marked, F.rlike(chunk, F.lit(lx.RUST_VALUE_HEAD))).otherwise(F.rlike(chunk, F.lit(lx.RUST_BARE_VALUE_HEAD)))
    untyped = F.col("kind").isin(*VALUE_KINDS) & ~typed
    return found.withColumn("kind", F.when(~untyped, F.col("kind")))


def _measured_heads(rows: DataFrame) -> DataFrame:
    """Extracts what the windows need of a head while the text is at hand."""
    chunk, kind = F.col("chunk"), F.col("kind")
    bare = F.regexp_replace(chunk, lx.RUST_COMMENT, " ")
    # `impl<..> [!]Trait for Target where .. {`; the `for` of `for<'a>` is not the divider.
    header = F.when(kind == "impl", F.regexp_replace(bare, r"^[\s\S]*?\bimpl\b\s*", ""))
    named = F.regexp_replace(after_angles(F.col("_header")), r"\bwhere\b[\s\S]*$|\{\z", "")
    opener, marked = F.col("term").isin(*OPENERS), F.col("marked")
    extern = F.when(marked, F.rlike(chunk, F.lit(lx.RUST_EXTERN_BLOCK))).otherwise(F.rlike(chunk, F.lit(lx.RUST_BARE_EXTERN_BLOCK)))
    rows = rows.withColumn("_header", header).withColumn("_impl", named).withColumn(
        "block",
        F.when(opener & F.rlike(chunk, F.lit(lx.RUST_MACRO_OPEN)), "macro")
        .when((F.col("term") == "{") & F.contains(chunk, F.lit("extern")) & extern, "extern")
        # an attribute that is followed as structure, as it nests deep
        .when(F.col("term").isin("(", "[") & marked & F.rlike(chunk, F.lit(lx.RUST_ATTRIBUTE_OPEN)), "attribute"),
    )
    header = F.col("_impl")
    divided = F.regexp_extract(header, r"^([\s\S]*?)\s+for\b(?!\s*<)([\s\S]*)$", 2)
    target = F.when(divided == "", header).otherwise(divided)
    trait_path = F.regexp_extract(header, r"^\s*!?([\s\S]*?)\s+for\b(?!\s*<)([\s\S]*)$", 1)
    prefix = F.regexp_replace(F.regexp_extract(chunk, lx.RUST_PREFIX, 0), lx.RUST_COMMENT, "")
    is_test = marked & F.rlike(prefix, F.lit(lx.RUST_TEST_ATTRIBUTE))
    head = F.struct(
        F.coalesce("kind", "block").alias("kind"),
        F.when(kind == "impl", spaced_tokens(target))
        .when(kind.isNotNull(), F.regexp_extract("_head", rf"({lx.RUST_IDENT})\z", 1))
        .alias("name"),
        F.when(kind == "impl", text_or_null(spaced_tokens(trait_path))).alias("trait_path"),
        F.when((kind == "fn") | (F.col("block") == "attribute"), is_test).alias("is_test"),
    )
    return measured(rows, lx.RUST_LEAD, lx.RUST_MARKED, F.when(kind.isNotNull() | F.col("block").isNotNull(), head))


def rust_rows(files: DataFrame) -> DataFrame:
    """Structural rows of Rust files with their heads, one level window applied."""
    rows = without_plain_statements(nested(_measured_heads(_heads(chunks(files, "rust")))))
    kind = F.col("head.kind")
    own = F.struct(
        kind.alias("kind"),
        F.col("head.name").alias("name"),
        F.col("head.trait_path").alias("trait_path"),
        F.col("head.is_test").alias("is_test"),
        "pos",
        "cum0",
        "start_line",
    )
    w = level_window()
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    at_level = ~F.col("marker")
    rows = with_block_markers(rows).withColumn("macro", F.coalesce(kind == "macro", F.lit(False)))
    rows = after_attribute(rows, kind == "attribute", F.col("head.is_test"))
    own = own.withField("is_test", own["is_test"] | F.coalesce("attribute.marked", F.lit(False)))
    rows = rows.withColumn("own", F.when(kind.isin(*BLOCK_KINDS, *VALUE_KINDS), own))
    ends = F.col("term") == ";"
    begins = F.col("term") == "{"
    # A head not finished by its own chunk waits for its terminator on its level.
    none = F.struct(F.lit(None).cast(HEAD).alias("h"))
    waits = F.struct(F.col("own").alias("h"))
    value_mark = F.when(at_level & F.col("own.kind").isin(*VALUE_KINDS) & F.col("opener"), waits).when(
        at_level & ends, none
    )
    block_mark = F.when(
        at_level & F.col("own.kind").isin(*BLOCK_KINDS) & F.col("term").isin("(", "["), waits
    ).when(at_level & (ends | begins), none)
    # A parent that is not a `{` block (macro call, argument list) holds no items.
    own_block = F.when(begins, F.coalesce(kind, F.lit("block"))).otherwise(F.lit("group"))
    parent = F.when(
        F.col("marker"),
        F.struct(own_block.alias("kind"), F.col("head.name").alias("name"), F.col("head.trait_path").alias("trait_path")),
    )
    return (
        rows.withColumns(
            {
                "parent": F.last(parent, ignorenulls=True).over(before),
                "waiting_value": F.last(value_mark, ignorenulls=True).over(before)["h"],
                "waiting_block": F.last(block_mark, ignorenulls=True).over(before)["h"],
                "close_cum": F.when(F.col("opener"), F.lead("cum1").over(w)),
                "close_line": F.when(F.col("opener"), F.lead("end_line").over(w)),
                "unpaired": unpaired(F.lag("term").over(w), F.col("term")),
                "closes_macro": F.when(F.col("closer"), F.lag("macro").over(w)).otherwise(F.lit(False)),
            }
        )
        .filter(at_level)
    )


def block_parent(files: DataFrame) -> DataFrame:
    """Heads of Rust definitions with the kind and name of the enclosing block."""
    rows = rust_rows(files).filter(F.col("own").isNotNull())
    return rows.select(
        *FILE,
        "path",
        F.col("pos").alias("ord"),
        "level",
        "own.kind",
        "own.name",
        F.coalesce(F.col("parent.kind"), F.lit("file")).alias("parent_kind"),
        F.col("parent.name").alias("parent_name"),
    )


def rust_items(files: DataFrame, with_files: bool = False) -> DataFrame:
    """Items of Rust files; ``with_files`` adds one ``file`` row per file, and its status
    (``structure.status_of``)."""
    rows = rust_rows(files)
    own = F.col("own")
    ends = F.col("term") == ";"
    begins = F.col("term") == "{"
    head = (
        F.when(own["kind"].isin(*VALUE_KINDS) & ends, own)
        .when(own["kind"].isin(*BLOCK_KINDS) & (ends | begins), own)
        .when(own.isNull() & ends & F.col("waiting_value").isNotNull(), F.col("waiting_value"))
        .when(own.isNull() & (ends | begins) & F.col("waiting_block").isNotNull(), F.col("waiting_block"))
    )
    so_far = file_window().rowsBetween(Window.unboundedPreceding, -1)
    in_macro = F.sum(
        F.when(F.col("macro"), 1).when(F.col("closes_macro"), -1).otherwise(0)
    ).over(so_far)
    is_file = (F.col("term") == "") if with_files else F.lit(False)
    found = (
        rows.withColumn("h", head)
        .filter(F.col("h").isNotNull() | F.col("macro") | F.col("closes_macro") | F.col("unpaired") | is_file)
        .withColumns({"macro_depth": F.coalesce(in_macro, F.lit(0)), "unpaired": F.max("unpaired").over(so_far)})
        .filter((F.col("h").isNotNull() & (F.col("macro_depth") == 0)) | is_file)
    )
    kind, parent = F.col("h.kind"), F.coalesce(F.col("parent.kind"), F.lit("file"))
    has_body = begins
    category = (
        F.when(is_file, "file")
        .when(parent.isin("group", "extern"), None)
        .when((kind == "fn") & has_body & (parent == "impl"), "impl_method")
        .when((kind == "fn") & has_body & (parent == "trait"), "trait_method")
        .when((kind == "fn") & has_body & F.col("h.is_test"), "test_function")
        .when((kind == "fn") & has_body, "file_scope_function")
        .when(kind == "struct", "struct")
        .when((kind == "enum") & has_body, "enum")
        .when((kind == "trait") & has_body, "trait")
        .when((kind == "impl") & has_body, "impl_block")
        .when(kind.isin(*VALUE_KINDS) & ~parent.isin("impl", "trait"), kind)
    )
    name = F.col("h.name")
    owner = F.when(F.col("category").isin("impl_method", "trait_method"), F.col("parent.name"))
    owner_trait = F.when(F.col("category") == "impl_method", F.col("parent.trait_path")).when(
        F.col("category") == "impl_block", F.col("h.trait_path")
    )
    display = (
        F.when(
            (F.col("category") == "impl_method") & F.col("parent.trait_path").isNotNull(),
            F.concat("parent.trait_path", F.lit(" for "), "parent.name", F.lit("::"), name),
        )
        .when(F.col("category") == "impl_method", F.concat("parent.name", F.lit("::"), name))
        .when(F.col("category") == "trait_method", F.concat(F.lit("trait "), F.col("parent.name"), F.lit("::"), name))
        .otherwise(name)
    )
    status = status_of(F.col("unclosed"), F.coalesce("unpaired", F.lit(False)), F.col("depth"))
    last_cum = F.when(has_body, F.col("close_cum")).otherwise(F.col("cum1"))
    last_line = F.when(has_body, F.col("close_line")).otherwise(F.col("end_line"))
    return (
        found.withColumn("category", category)
        .filter(F.col("category").isNotNull())
        .withColumn("loc", F.when(is_file, F.col("cum1")).otherwise(last_cum - F.col("h.cum0") + 1).cast("bigint"))
        .filter((F.col("loc") > 0) | is_file)
        .select(
            *item_projection(
                "rust",
                ordinal=F.coalesce("h.pos", "pos"),
                name=name,
                owner=owner,
                owner_trait=owner_trait,
                display_name=display,
                start_line=F.coalesce("h.start_line", F.lit(1)),
                end_line=last_line,
            ),
            *([F.when(is_file, status).alias("status")] if with_files else []),
        )
    )
