"""Definitions in C# files.

C# members have no leading keyword, so a chunk is classified by its shape, and
which shapes apply depends on the block it stands in: types and namespaces hold
members, code blocks hold statements and local functions, properties hold accessors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcmetrics.functions import lexical as lx
from srcmetrics.functions.nesting import peeled
from srcmetrics.operators.items import item_projection
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

TYPE_BLOCKS = ("type", "interface")
MEMBER_BLOCKS = ("property", "indexer", "event")
TOP_LEVEL = "top-level statements"


TYPE_SHAPES = ("class", "struct", "record", "interface", "enum")


def _matches(text: Column, pattern: str) -> Column:
    return F.rlike(text, F.lit(pattern))


def _first(text: Column, pattern: str) -> Column:
    """First group of the first match, null where there is none."""
    found = F.regexp_extract(text, pattern, 1)
    return F.when(found != "", found)


def _signatures(cut: DataFrame) -> DataFrame:
    """Brings each possible head into one plain form, step by step.

    ``head``  the chunk without attributes and comments;
    ``flat``  the head without modifiers, with round groups as ``()`` and without
              type arguments and array marks;
    ``sign``  what ends the signature: ``{``, ``;``, ``=>`` or ``=``;
    ``words`` what stands before it. Every pattern runs in one pass.
    """
    chunk = F.col("chunk")
    may_head = F.col("term").isin("{", ";", "(", "[")
    bare = F.when(_matches(chunk, lx.CS_MARKED), F.regexp_replace(chunk, lx.CS_PREFIX, "")).otherwise(
        F.ltrim(chunk, F.lit(lx.BLANKS))
    )
    commented = F.contains("_bare", F.lit("/")) | F.contains("_bare", F.lit("#"))
    clean = F.when(commented, F.regexp_replace("_bare", lx.CS_COMMENT, " ")).otherwise(F.col("_bare"))
    # a group that is followed as structure stands as `()`, too
    closed = F.when(F.col("term") == "(", F.concat("_body", F.lit(")"))).otherwise(F.col("_body"))
    called = peeled(F.col("_closed"), lx.CS_PARENS, "()", "(", lx.PEEL_LEVELS)
    flat = peeled(F.col("_called"), lx.CS_TYPE_ARGUMENTS, "", "<", lx.PEEL_LEVELS)
    return (
        cut.withColumn("_bare", F.when(F.col("closer"), F.lit("")).otherwise(bare))
        .withColumn("head", F.trim(clean))
        .withColumn("plain", ~may_head | (F.col("head") == "") | F.startswith("head", F.lit(":")) | _matches(F.col("head"), lx.CS_PLAIN))
        .withColumn("_body", F.when(~F.col("plain"), F.regexp_replace("head", lx.CS_MODIFIERS, "")))
        .withColumn("_closed", closed)
        .withColumn("_called", called)
        .withColumn("flat", F.regexp_replace(flat, lx.CS_TYPE_MARKS, ""))
        .withColumn("sign", _first(F.col("flat"), lx.CS_SIGN))
        .withColumn("words", F.trim(F.regexp_extract("flat", r"^[^={;]*+", 0)))
    )


def _shapes(rows: DataFrame) -> DataFrame:
    """``shape``/``name``: what the head declares where members are allowed;
    ``local_name``: the local function it declares where statements are."""
    head, flat, words, sign = F.col("head"), F.col("flat"), F.col("words"), F.col("sign")
    declared = _first(F.col("_body"), lx.CS_DECLARED)
    rows = rows.withColumn("declared", declared).withColumn(
        "operator", F.contains("_body", F.lit("operator")) & _matches(flat, lx.CS_OPERATOR)
    ).withColumn(
        "conversion", F.contains("_body", F.lit("operator")) & _matches(F.col("_body"), lx.CS_CONVERSION)
    )
    declared = F.col("declared")
    called = F.contains(words, F.lit("()"))
    two_words = _matches(words, r"\S\s+@?\w")
    shape = (
        F.when(F.col("plain"), None)
        .when(declared.isin(*TYPE_SHAPES) & F.col("term").isin("{", ";") & _matches(F.col("_body"), lx.CS_TYPE_NAME), declared)
        .when(declared.isin("namespace", "delegate", "event"), declared)
        .when(declared == "using", None)
        .when(F.col("conversion"), "conversion")
        .when(F.col("operator"), "operator")
        .when(_matches(F.col("_body"), lx.CS_INDEXER), "indexer")
        .when(F.startswith(words, F.lit("~")) & called, "destructor")
        .when(called & ((sign != "=") | sign.isNull()), "method")
        .when(two_words & sign.isin("{", "=>"), "property")
        .when(two_words & sign.isin("=", ";"), "field")
    )
    rows = rows.withColumn("shape", shape)
    kind = F.col("shape")
    call_name = F.regexp_extract(F.regexp_replace(words, r"^delegate\s+", ""), lx.CS_CALL_NAME, 1)
    member_words = F.regexp_replace(words, r"^event\s+", "")
    name = (
        F.when(kind.isin(*TYPE_SHAPES), F.regexp_extract("_body", lx.CS_TYPE_NAME, 1))
        .when(kind.isin("delegate", "method"), call_name)
        .when(kind.isin("event", "field"), F.regexp_extract(member_words, lx.CS_FIRST_DECLARATOR, 1))
        .when(
            kind == "conversion",
            F.concat(
                F.regexp_extract("_body", lx.CS_CONVERSION, 1),
                F.lit(" operator "),
                F.trim(F.regexp_extract("_body", lx.CS_CONVERSION, 2)),
            ),
        )
        .when(kind == "operator", F.concat(F.lit("operator "), F.regexp_extract(flat, lx.CS_OPERATOR, 1)))
        .when(kind == "indexer", F.lit("this[]"))
        .when(kind == "destructor", F.concat(F.lit("~"), call_name))
        .when(kind == "property", F.regexp_extract(words, lx.CS_LAST_NAME, 1))
    )
    constness = F.when(_matches(head, lx.CS_CONST), "const").when(_matches(head, lx.CS_STATIC), "static").otherwise("plain")
    member_arrow = F.when(kind.isin("operator", "conversion"), _matches(flat, r"\(\)\s*=>")).otherwise(sign == "=>")
    return rows.withColumn("arrow", F.coalesce(member_arrow, F.lit(False))).select(
        "*",
        name.alias("name"),
        F.when(kind == "field", constness).alias("field_kind"),
        F.when(~F.col("plain") & called & (F.col("arrow") | (sign == "{")), _first(words, lx.CS_LOCAL_FUNCTION)).alias("local_name"),
        F.when(~F.col("plain"), _first(F.col("_body"), lx.CS_ACCESSOR)).alias("accessor"),
        # A field value or an expression body may hold braces; both run to the `;`.
        (F.coalesce(kind == "field", F.lit(False)) | (kind.isNotNull() & F.col("arrow"))).alias("to_semicolon"),
    )


def _statement_marks(rows: DataFrame) -> DataFrame:
    """How a chunk begins and what kind of block it opens, for statements at the
    top of a file."""
    head = F.col("head")
    word = F.regexp_extract(head, r"^[A-Za-z]++", 0)
    begins_as = (
        F.when(word.isin("else", "catch", "finally"), "tail")
        .when((word == "while") & (F.col("term") == ";"), "while")
        .when(word.isin("using", "global", "extern") & _matches(head, lx.CS_USING), "using")
        .when(head.isin("", ";"), "empty")
    )
    opens_as = F.when(
        F.col("opener"),
        F.when(word == "do", "do").when(F.col("local_name").isNotNull() & ~F.col("arrow"), "block").when(
            _matches(head, lx.CS_BLOCK_STATEMENT), "block"
        ),
    )
    return rows.select("*", begins_as.alias("begins_as"), opens_as.alias("opens_as"))


HEAD_FIELDS = [
    "shape", "name", "field_kind", "local_name", "accessor", "to_semicolon", "arrow", "begins_as", "opens_as",
    "in_attribute",
]


def csharp_rows(files: DataFrame) -> DataFrame:
    """Structural rows of C# files with shapes, one level window applied."""
    cut = chunks(files, "csharp").withColumns(
        {"closer": F.col("term").isin("}", ")", "]"), "opener": F.col("term").isin(*OPENERS)}
    )
    in_attribute = F.when(F.col("opener") & F.startswith("_bare", F.lit("[")), "attribute")
    marked = _statement_marks(_shapes(_signatures(cut))).withColumn("in_attribute", in_attribute)
    anything = F.coalesce("shape", "local_name", "accessor", "begins_as", "opens_as", "in_attribute").isNotNull()
    rows = measured(marked, lx.CS_LEAD, lx.CS_MARKED, F.when(anything, F.struct(*HEAD_FIELDS)), "csharp")
    rows = with_block_markers(without_plain_statements(nested(rows)))
    rows = after_attribute(rows, F.col("head.in_attribute").isNotNull(), F.lit(False))
    w = level_window()
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    at_level = ~F.col("marker")
    head = F.col("head")
    kind = head["shape"]
    no = F.lit(False)
    arrow, to_semicolon = F.coalesce(head["arrow"], no), F.coalesce(head["to_semicolon"], no)
    block = (
        F.when(F.col("term") != "{", "code")
        .when(kind.isin("class", "struct", "record"), "type")
        .when(kind.isin("interface", "enum", "namespace"), kind)
        .when(kind.isin(*MEMBER_BLOCKS) & ~arrow, "member")
        .otherwise("code")
    )
    own = F.struct(
        *[head[f].alias(f) for f in ("shape", "name", "field_kind", "local_name", "accessor")],
        "pos",
        "cum0",
        "start_line",
    )
    declares = F.coalesce(head["shape"], head["local_name"], head["accessor"]).isNotNull()
    # A value or expression body runs to its `;`, other heads to that or to their block.
    waits = F.col("opener") & declares & (to_semicolon | arrow)
    waits_for_block = F.col("opener") & declares & ~(to_semicolon | arrow) & (F.col("term") != "{")
    nothing = F.struct(F.lit(None).cast(
        "struct<shape:string,name:string,field_kind:string,local_name:string,accessor:string,"
        "pos:int,cum0:bigint,start_line:int>"
    ).alias("h"))
    mark = F.when(at_level & waits, F.struct(own.alias("h"))).when(at_level & (F.col("term") == ";"), nothing)
    block_mark = F.when(at_level & waits_for_block, F.struct(own.alias("h"))).when(
        at_level & F.col("term").isin(";", "{"), nothing
    )
    own_parent = F.when(F.col("marker"), F.struct(block.alias("kind"), head["name"].alias("name")))
    opened_as = F.when(
        F.col("opener"),
        F.when(F.col("block").isin("type", "interface", "enum", "namespace"), "block").otherwise(
            F.coalesce(head["opens_as"], F.lit("value"))
        ),
    )
    rows = (
        rows.withColumns(
            {
                "h0": F.when(declares, own),
                "block": block,
                "by_block": (F.col("term") == "{") & ~to_semicolon & ~arrow,
            }
        )
        .withColumns(
            {
                "parent": F.last(own_parent, ignorenulls=True).over(before),
                "waiting": F.last(mark, ignorenulls=True).over(before)["h"],
                "waiting_block": F.last(block_mark, ignorenulls=True).over(before)["h"],
                "close_cum": F.when(F.col("opener"), F.lead("cum1").over(w)),
                "close_line": F.when(F.col("opener"), F.lead("end_line").over(w)),
                "prev_term": F.lag("term").over(w),
                "unpaired": unpaired(F.lag("term").over(w), F.col("term")),
                "next_term": F.lead("term").over(w),
                "prev_opened_as": F.last(opened_as, ignorenulls=True).over(before),
            }
        )
    )
    return (
        _top_level_statements(rows)
        .filter(at_level)
        .withColumn("parent_kind", F.coalesce(F.col("parent.kind"), F.lit("file")))
    )


def _declared(rows: DataFrame) -> DataFrame:
    """Finished definitions: the head ``h``, what it is (``role``), and its end."""
    ends = F.col("term") == ";"
    by_block = F.col("by_block")
    head = F.when(by_block, F.coalesce("h0", "waiting_block")).when(ends, F.coalesce("waiting", "waiting_block", "h0"))
    rows = rows.withColumn("h", head)
    h, parent = F.col("h"), F.col("parent_kind")
    holds_types = parent.isin("file", "namespace", *TYPE_BLOCKS)
    shape = h["shape"]
    role = (
        F.when(holds_types & shape.isin("class", "struct", "record", "interface", "enum", "delegate"), shape)
        .when(parent.isin(*TYPE_BLOCKS) & (shape == "event") & by_block, "event")
        .when(parent.isin(*TYPE_BLOCKS) & (shape == "event") & ~by_block, "event_field")
        .when(parent.isin(*TYPE_BLOCKS) & (shape == "field") & h["field_kind"].isin("const", "static"), h["field_kind"])
        .when(parent.isin(*TYPE_BLOCKS) & shape.isin("property", "indexer") & by_block, "with_accessors")
        .when(
            parent.isin(*TYPE_BLOCKS)
            & shape.isin("method", "destructor", "operator", "conversion", "property", "indexer"),
            "callable",
        )
        .when((parent == "member") & h["accessor"].isNotNull(), "accessor")
        .when((parent == "code") & h["local_name"].isNotNull(), "local")
    )
    return (
        rows.withColumn("role", role)
        .withColumn("last_cum", F.when(by_block, F.col("close_cum")).otherwise(F.col("cum1")))
        .withColumn("last_line", F.when(by_block, F.col("close_line")).otherwise(F.col("end_line")))
    )


def _top_level_statements(rows: DataFrame) -> DataFrame:
    """Adds ``statement_loc`` on the last row of each statement at the top of a file.

    At level 0 a statement begins after a ``;``, or after a ``}`` that closed a
    block unless what follows goes on with it (``else``, ``catch``, ``while`` ...).
    """
    w = level_window()
    follows = F.coalesce("head.begins_as", F.lit("code"))
    opened_as = F.col("prev_opened_as")
    starts = (
        F.col("prev_term").isNull()
        | (F.col("prev_term") == ";")
        | (
            (F.col("prev_term") == "}")
            & opened_as.isin("block", "do")
            & (follows != "tail")
            & ~((follows == "while") & (opened_as == "do"))
        )
    )
    declares = F.col("head.shape").isin(*TYPE_SHAPES, "delegate", "namespace") | follows.isin("using", "empty")
    first = F.when(
        F.col("_starts"),
        F.struct("cum0", "start_line", F.coalesce(declares, F.lit(False)).alias("declares")),
    )
    ground = (F.col("level") == 0) & (F.col("term") != "")
    last = F.coalesce(F.col("_next_starts"), F.lit(True)) | (F.col("next_term") == "")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("_starts", ground & starts)
        .withColumns(
            {"_first": F.last(first, ignorenulls=True).over(so_far), "_next_starts": F.lead("_starts").over(w)}
        )
        .withColumns(
            {
                "statement_loc": F.when(
                    ground & last & ~F.col("_first.declares"), F.col("cum1") - F.col("_first.cum0") + 1
                ),
                "statement_line": F.col("_first.start_line"),
            }
        )
        .drop("prev_term", "next_term", "prev_opened_as", "_starts", "_next_starts", "_first")
    )


def _with_context(rows: DataFrame) -> DataFrame:
    """Adds, in file order, the member an accessor belongs to and whether the
    outermost block is a statement (whose content is not looked into); gives the
    first statement of a file the sum over all of them."""
    ordered = file_window()
    here = ordered.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*FILE)
    member = F.when(
        F.col("role").isin("with_accessors", "event"),
        F.struct(F.col("h.name").alias("name"), F.col("parent").alias("owner")),
    )
    outermost = F.when((F.col("level") == 0) & F.col("opener"), F.col("block").isin("type", "interface", "namespace"))
    is_statement = F.col("statement_loc").isNotNull()
    role = (
        F.when(F.col("role").isNotNull(), F.col("role"))
        .when(is_statement & (F.col("_statement") == 1) & (F.col("statements_loc") > 0), "statements")
        .when(F.col("term") == "", "file")
    )
    return (
        rows.filter(
            F.col("role").isNotNull()
            | is_statement
            | ((F.col("level") == 0) & F.col("opener"))
            | (F.col("term") == "")
            | F.col("unpaired")
        )
        .withColumns(
            {
                "unpaired": F.max("unpaired").over(here),
                "member": F.last(member, ignorenulls=True).over(here),
                "in_declaration": F.last(outermost, ignorenulls=True).over(here),
                "_statement": F.sum(F.when(is_statement, 1)).over(here),
                "statements_loc": F.sum("statement_loc").over(whole),
                "statements_end": F.max(F.when(is_statement, F.col("end_line"))).over(whole),
            }
        )
        .withColumn("role", role)
        .filter(F.col("role").isNotNull())
    )


def csharp_items(files: DataFrame, with_files: bool = False) -> DataFrame:
    """Items of C# files; ``with_files`` adds one ``file`` row per file, and its status
    (``structure.status_of``)."""
    found = _with_context(_declared(csharp_rows(files))).filter(
        (F.col("role") != "with_accessors") & ((F.col("role") != "local") | F.col("in_declaration"))
    )
    if not with_files:
        found = found.filter(F.col("role") != "file")
    role, h = F.col("role"), F.col("h")
    summed = role == "statements"
    owner = F.when(role == "accessor", F.col("member.owner")).when(~summed, F.col("parent"))
    found = found.withColumn("owned_by", owner).withColumn(
        "item_name",
        F.when(role == "accessor", F.concat(F.col("member.name"), F.lit("."), h["accessor"]))
        .when(role == "local", F.concat(F.lit("local "), h["local_name"]))
        .when(summed, F.lit(TOP_LEVEL))
        .when(role != "file", h["name"]),
    )
    in_interface = F.coalesce(F.col("owned_by.kind") == "interface", F.lit(False))
    callable_category = F.when(in_interface, "trait_method").otherwise("impl_method")
    categories = (
        F.when(role.isin("class", "struct", "record"), F.array(F.lit("struct"), F.lit("impl_block")))
        .when(role == "interface", F.array(F.lit("trait"), F.lit("impl_block")))
        .when(role == "event_field", F.array(F.lit("event")))
        .when(role.isin("callable", "accessor"), F.array(callable_category))
        .when(role.isin("local", "statements"), F.array(F.lit("file_scope_function")))
        .otherwise(F.array(role))
    )
    loc = (
        F.when(summed, F.col("statements_loc"))
        .when(role == "file", F.col("cum1"))
        .otherwise(F.col("last_cum") - h["cum0"] + 1)
    )
    out = (
        found.withColumn("loc", loc.cast("bigint"))
        .filter((F.col("loc") > 0) | (role == "file"))
        .withColumn("category", F.explode(categories))
    )
    is_method = F.col("category").isin("impl_method", "trait_method")
    status = status_of(F.col("unclosed"), F.col("unpaired"), F.col("depth"))
    return out.select(
        *item_projection(
            "csharp",
            # statements are summed up after every other entry of the file
            ordinal=F.when(summed, F.lit(2**31 - 1)).when(role == "file", F.col("pos")).otherwise(h["pos"]),
            name=F.col("item_name"),
            owner=F.when(is_method, F.col("owned_by.name")),
            owner_trait=F.when((F.col("category") == "impl_block") & (role == "interface"), F.lit("interface")),
            display_name=F.col("item_name"),
            start_line=F.when(summed, F.col("statement_line")).when(role == "file", F.lit(1)).otherwise(h["start_line"]),
            end_line=F.when(summed, F.col("statements_end")).when(role == "file", F.col("end_line")).otherwise(F.col("last_line")),
        ),
        *([F.when(role == "file", status).alias("status")] if with_files else []),
    )
