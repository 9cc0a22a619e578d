"""Nesting to any depth, which a regular expression alone cannot follow.

A text is cut at what may open or close something, and each piece takes a running state to the
next: what the piece leaves open, if it is read on from what was open before it. Only texts
that do nest take this way; the others pass one cheap test.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_RAW_START = r'(?<!\w)[bc]?r#*+"'
_RUST_WHOLE = (
    r"""[^"'/bcr]++"""
    rf"|(?!{_RAW_START})[bcr]"
    r'|(?<!\w)[bc]?r(?<fence>#*+)"[\s\S]*?"\k<fence>'
    r'|"(?:[^"\\]++|\\[\s\S])*+"'
    r"|'(?:[^'\\\n]|\\(?:u\{[0-9a-fA-F_]*+\}|x[0-9a-fA-F]{2}|[^ux\n]))'"
    r"|//[^\n]*+\n|/\*[\s\S]*?\*/|/(?![/*]|\z)|'"
)
_RUST_OPEN = rf'({_RAW_START})[\s\S]*+|(")(?:[^"\\]++|\\[\s\S])*+(\\)?|(//)[^\n]*+|(/\*)[\s\S]*+|(/)'
_CSHARP_WHOLE = (
    r"""[^"'/#$@]++|//[^\n]*+\n|#[^\n]*+\n|/\*[\s\S]*?\*/|/(?![/*]|\z)"""
    r'|\$*+(?<fence>"{3,}+)[\s\S]*?\k<fence>(?!")'
    r'|(?:@\$?|\$@)"(?:[^"]++|"")*+"'
    r'|\$(?!@?")|@(?!\$?")'
    r'|\$"(?:[^"\\{\n]++|\\.|\{\{|\{(?:[^{}"\n]++|"(?:[^"\\\n]++|\\.)*+")*+\})*+(?:"|(?=\n))'
    r'|(?<![$@])"(?!"")(?:[^"\\\n]++|\\.)*+(?:"|(?=\n))|""(?!")'
    r"|'(?:[^'\\\n]|\\.[0-9a-fA-F]{0,8})'|'"
)
_CSHARP_OPEN = r'(\$*+"{3,}+)[\s\S]*+|((?:@\$?|\$@)")[\s\S]*+|(\$?")[^\n]*+|(//|#)[^\n]*+|(/\*)[\s\S]*+|(/)'
_END_STATE = {
    "rust": rf"\A(?:{_RUST_WHOLE})*+(?:{_RUST_OPEN})?\z",
    "csharp": rf"\A(?:{_CSHARP_WHOLE})*+(?:{_CSHARP_OPEN})?\z",
}
_NESTED_COMMENT = r"/\*(?:[^*/]++|\*(?!/)|/(?!\*))*+/\*"
_MARK = r"/\*|\*/"
#: Items that take a running state along before what they found is put away.
BLOCK = 256


def end_state(text: Column, language: str) -> Column:
    """What opens the literal or comment that ``text``, read from its start as code, does not
    close: ``"``, ``r##"``, ``//``, ``/*`` ...; empty if it ends as code."""
    return F.regexp_replace(text, _END_STATE[language], "$1$2$3$4$5$6")


def unterminated(text: Column, language: str) -> Column:
    """Whether text that begins as code ends inside a literal or a block comment."""
    return F.rlike(end_state(text, language), F.lit(r'\A(?:(?:[bc]?r#*+|\$*+|@\$?|\$@)"++\\?|/\*)\z'))


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.transform(F.array(value), use)[0]


def _by_blocks(items: Column, start: Column, step, found: str, kind: str) -> Column:
    """What a running state finds (its array ``found`` of type ``kind``) over all items. Each step
    copies its state, so only the finds of one block are part of it; those of the blocks before
    are copied once a block."""
    none = F.array().cast(kind)
    outer = F.struct(start.alias("state"), F.array().cast(f"array<{kind}>").alias("blocks"))

    def block(acc: Column, at: Column) -> Column:
        def put_away(state: Column) -> Column:
            return F.struct(
                state.withField(found, none).alias("state"), F.concat(acc["blocks"], F.array(state[found])).alias("blocks")
            )

        return _once(F.aggregate(F.slice(items, at + 1, BLOCK), acc["state"], step), put_away)

    places = F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0)), F.lit(BLOCK))
    return F.aggregate(places, outer, block, lambda end: F.flatten(end["blocks"]))


def flat_comments(text: Column) -> Column:
    """Rust text in which each comment marker inside a block comment is two dashes, so that no
    block comment holds another one. Nothing moves, and blank lines stay as they are.

    The text is cut at all markers. Outside block comments a piece is read on from what was
    left open before it, which tells whether the marker after it counts; inside them markers
    count up and down."""
    cut = F.struct(
        F.regexp_extract_all(text, F.lit(_MARK), F.lit(0)).alias("marks"), F.split(text, _MARK, -1).alias("pieces")
    )
    return F.when(F.rlike(text, F.lit(_NESTED_COMMENT)), _once(cut, _flattened)).otherwise(text)


def _flattened(cut: Column) -> Column:
    marks, pieces = cut["marks"], cut["pieces"]
    start = F.struct(
        F.lit("").alias("state"),
        F.lit(0).alias("depth"),
        F.lit(0).alias("i"),
        F.lit(0).alias("opened"),  # the marker that opened the comment
        F.lit(False).alias("deep"),
        F.array().cast("array<struct<opened:int,closed:int>>").alias("nested"),
    )

    def step(acc: Column, piece: Column) -> Column:
        mark = piece["mark"]
        read = F.when(acc["depth"] > 0, F.lit("/*")).otherwise(end_state(F.concat(acc["state"], piece["text"]), "rust"))

        def moved(state: Column) -> Column:
            inside = F.startswith(state, F.lit("/*"))
            before = F.when(inside, F.greatest(acc["depth"], F.lit(1))).otherwise(0)
            counts = inside | (state == "")
            up, down = counts & (mark == "/*"), inside & (mark == "*/")
            depth = before + F.when(up, 1).when(down, -1).otherwise(0)
            deep = F.when(depth > 1, True).when(depth == 0, False).otherwise(acc["deep"] & inside)
            # a comment ends at its last marker, or with the text
            ends = (down & (depth == 0) & acc["deep"]) | (mark.isNull() & deep)
            span = F.struct(acc["opened"].alias("opened"), acc["i"].alias("closed"))
            return F.struct(
                F.when(depth > 0, "").when(down, "").otherwise(F.concat(state, F.coalesce(mark, F.lit("")))).alias("state"),
                depth.alias("depth"),
                (acc["i"] + 1).alias("i"),
                F.when(before == 0, acc["i"]).otherwise(acc["opened"]).alias("opened"),
                deep.alias("deep"),
                F.when(ends, F.concat(acc["nested"], F.array(span))).otherwise(acc["nested"]).alias("nested"),
            )

        return _once(read, moved)

    zipped = F.zip_with(pieces, marks, lambda p, m: F.struct(p.alias("text"), m.alias("mark")))

    def joined(spans: Column) -> Column:
        ahead = F.concat(F.array(F.struct(F.lit(0).alias("opened"), F.lit(0).alias("closed"))), spans)
        kept = F.zip_with(
            spans,
            ahead,
            lambda s, a: F.when(s.isNull(), F.slice(marks, a["closed"] + 1, F.size(marks))).otherwise(
                F.concat(
                    F.slice(marks, a["closed"] + 1, s["opened"] - a["closed"] + 1),
                    F.array_repeat(F.lit("--"), s["closed"] - s["opened"] - 1),
                )
            ),
        )
        new_marks = F.concat(F.flatten(kept), F.array(F.lit("")))
        return F.array_join(F.zip_with(pieces, new_marks, lambda p, m: F.concat(p, m)), "")

    found = _once(zipped, lambda z: _by_blocks(z, start, step, "nested", "array<struct<opened:int,closed:int>>"))
    return _once(found, joined)


def after_angles(text: Column) -> Column:
    """``text`` without the balanced ``<...>`` it begins with; the ``>`` of an arrow closes
    nothing. A list that is not closed stays."""
    tokens = F.regexp_extract_all(text, F.lit(r"->|=>|[<>]|[^<>=-]++|[=-]"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def step(acc: Column, token: Column) -> Column:
        depth = acc["depth"] + F.when(token == "<", 1).when(token == ">", -1).otherwise(0)
        return F.when(
            acc["open"], F.struct(depth.alias("depth"), (acc["n"] + 1).alias("n"), (depth > 0).alias("open"))
        ).otherwise(acc)

    rest = _once(
        F.aggregate(tokens, start, step),
        lambda end: F.when(end["open"], text).otherwise(F.array_join(F.slice(tokens, end["n"] + 1, F.size(tokens)), "")),
    )
    return F.when(F.startswith(text, F.lit("<")), rest).otherwise(text)


def peeled(text: Column, pattern: str, replacement: str, opener: str, levels: int) -> Column:
    """``text`` with all groups that ``pattern`` matches to ``levels`` levels replaced, however
    deep they nest: the innermost levels go first, as often as there may be levels left."""
    once = F.regexp_replace(text, pattern, replacement)
    openers = F.length(text) - F.length(F.replace(text, F.lit(opener), F.lit("")))
    # a replacement may leave one level; many groups side by side are done at once
    times = F.floor(openers / F.lit(levels - 1)).cast("int") + 1
    start = F.struct(text.alias("text"), F.lit(False).alias("done"))

    def step(acc: Column, _: Column) -> Column:
        def compared(less: Column) -> Column:
            return F.struct(less.alias("text"), (less == acc["text"]).alias("done"))

        return F.when(acc["done"], acc).otherwise(_once(F.regexp_replace(acc["text"], pattern, replacement), compared))

    again = F.aggregate(F.sequence(F.lit(1), times), start, step, lambda end: end["text"])
    return F.when(~F.contains(text, F.lit(opener)), text).when(openers > levels, again).otherwise(once)


def parallel_branches(chunks: Column) -> Column:
    """For each chunk whether its last character belongs to a ``#else`` or ``#elif`` branch and
    has no partner in that branch.

    The branches of a condition are read side by side: what the first one opens or closes
    counts, and what a later one opens or closes beyond itself is the same once more. The numbers
    (from 0) of the marked chunks are found block by block."""
    branch = "struct<later:boolean,open:array<int>>"
    start = F.struct(
        F.array().cast(f"array<{branch}>").alias("stack"),
        F.array().cast("array<int>").alias("alone"),
        F.lit(0).alias("i"),
    )
    fresh = F.array().cast("array<int>")

    def state(acc: Column, stack: Column, alone: Column) -> Column:
        return F.struct(stack.alias("stack"), alone.alias("alone"), acc["i"].alias("i"))

    def directed(acc: Column, word: Column) -> Column:
        top = F.try_element_at(acc["stack"], F.lit(-1))
        below = F.slice(acc["stack"], 1, F.greatest(F.size(acc["stack"]) - 1, F.lit(0)))
        left = F.concat(acc["alone"], top["open"])
        # a condition within a later branch is read like one
        inside = F.exists(acc["stack"], lambda b: b["later"])
        opened = F.concat(acc["stack"], F.array(F.struct(inside.alias("later"), fresh.alias("open"))))
        turned = F.concat(below, F.array(F.struct(F.lit(True).alias("later"), fresh.alias("open"))))
        has = F.size(acc["stack"]) > 0
        return (
            F.when(word == "if", state(acc, opened, acc["alone"]))
            .when(has & (word == "endif"), state(acc, below, left))
            .when(has, state(acc, turned, left))
            .otherwise(acc)
        )

    def step(acc: Column, chunk: Column) -> Column:
        words = F.regexp_extract_all(chunk, F.lit(r"(?m)^[ \t]*#[ \t]*(if|elif|else|endif)\b"), F.lit(1))
        last = F.right(chunk, F.lit(1))

        def bracketed(at: Column) -> Column:
            top = F.try_element_at(at["stack"], F.lit(-1))
            below = F.slice(at["stack"], 1, F.greatest(F.size(at["stack"]) - 1, F.lit(0)))
            later = F.coalesce(top["later"], F.lit(False))

            def with_open(open_: Column) -> Column:
                return F.concat(below, F.array(F.struct(F.lit(True).alias("later"), open_.alias("open"))))

            opens, closes = last.isin("{", "(", "["), last.isin("}", ")", "]")
            partner = F.size(top["open"]) > 0
            stack = (
                F.when(later & opens, with_open(F.concat(top["open"], F.array(at["i"]))))
                .when(later & closes & partner, with_open(F.slice(top["open"], 1, F.greatest(F.size(top["open"]) - 1, F.lit(0)))))
                .otherwise(at["stack"])
            )
            alone = F.when(later & closes & ~partner, F.concat(at["alone"], F.array(at["i"]))).otherwise(at["alone"])
            return F.struct(stack.alias("stack"), alone.alias("alone"), (at["i"] + 1).alias("i"))

        directs = F.contains(chunk, F.lit("#"))
        next_ = F.struct(acc["stack"].alias("stack"), acc["alone"].alias("alone"), (acc["i"] + 1).alias("i"))
        return (
            F.when(~directs & (F.size(acc["stack"]) == 0), next_)
            .when(directs, _once(F.aggregate(words, acc, directed), bracketed))
            .otherwise(bracketed(acc))
        )

    def flags(at: Column) -> Column:
        """The numbers as one flag for each chunk: a run of plain ones, a marked one and so on."""
        runs = F.zip_with(
            at,
            F.concat(F.array(F.lit(-1)), at),
            lambda here, ahead: F.when(here.isNull(), F.array_repeat(F.lit(False), F.size(chunks) - ahead - 1)).otherwise(
                F.concat(F.array_repeat(F.lit(False), here - ahead - 1), F.array(F.lit(True)))
            ),
        )
        return F.flatten(runs)

    found = _by_blocks(chunks, start, step, "alone", "array<int>")
    return _once(F.array_sort(found), flags)
