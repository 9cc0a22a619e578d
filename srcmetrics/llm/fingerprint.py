"""Document fingerprints that can be subtracted: invertible Bloom lookup tables of paragraph
digests, in DataFrame functions only.

A table has three parts of ``width`` cells. Each digest of a document is in one cell of each
part; a cell holds how many digests it has, the exclusive or of them, and that of their
checks. The difference of two tables holds the digests that are in one document only.
Peeling reads a digest from every cell that holds exactly one and takes it out of its other
cells, until no cell is left (whole) or none can be read (failed)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcmetrics.llm.sharding import prefix_sums
from srcmetrics.llm.store import stored

#: Cells of each of the three parts of the fingerprint that documents carry.
WIDTH = 8
#: Widths of the larger tables that are tried in turn, on parts of about PART digests.
LARGER, PART = (32, 128, 512), 32
#: Failed comparisons that one task repeats with larger tables.
TASK_ROWS = 4000
#: Rounds of peeling; a table that needs more counts as failed.
ROUNDS = 24
_CELL = "struct<n:int,k:bigint,c:bigint>"


def paragraph_digests(text: Column) -> Column:
    """64-bit digests of the distinct lines of a text that are not empty."""
    lines = F.filter(F.split(text, "\n"), lambda p: p != "")
    return F.array_distinct(F.transform(lines, lambda p: F.xxhash64(p)))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, computed once however often the body's lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _places(digest: Column, width: int, count: Column) -> Column:
    """A digest with its sign, check and three cells; each width hashes anew."""
    at = [
        (F.pmod(F.xxhash64(digest, F.lit(3 * width + j)), F.lit(width)) + F.lit(j * width)).cast("int").alias(f"p{j}")
        for j in range(3)
    ]
    return F.struct(
        digest.alias("k"), count.cast("int").alias("n"), F.xxhash64(digest, F.lit(-width)).alias("c"), *at
    )


def _without(cell: Column, place: Column) -> Column:
    return F.struct(
        (cell["n"] - place["n"]).alias("n"),
        cell["k"].bitwiseXOR(place["k"]).alias("k"),
        cell["c"].bitwiseXOR(place["c"]).alias("c"),
    )


def _taken_out(cells: Column, places: Column) -> Column:
    def one(cell: Column, i: Column) -> Column:
        here = F.filter(places, lambda q: (q["p0"] == i) | (q["p1"] == i) | (q["p2"] == i))
        return F.aggregate(here, cell, _without)

    return F.transform(cells, one)


def table(digests: Column, width: int) -> Column:
    """The cells of a set of digests."""
    empty = F.array_repeat(F.lit(None).cast(_CELL), 3 * width)
    empty = F.transform(empty, lambda _: F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("k"), F.lit(0).cast("bigint").alias("c")))
    places = F.transform(digests, lambda d: _places(d, width, F.lit(-1)))
    return _let(places, lambda q: _taken_out(empty, q))


def subtracted(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, _without)


def peeled(cells: Column, width: int) -> Column:
    """The digests of a difference of tables, or null if peeling fails."""

    def step(state: Column, _: Column) -> Column:
        single = F.filter(state["cells"], lambda c: (F.abs(c["n"]) == 1) & (F.xxhash64(c["k"], F.lit(-width)) == c["c"]))
        found = F.array_distinct(F.transform(single, lambda c: _places(c["k"], width, c["n"])))
        gone = _let(
            found,
            lambda q: F.struct(
                _taken_out(state["cells"], q).alias("cells"),
                F.concat(state["out"], F.transform(q, lambda p: p["k"])).alias("out"),
            ),
        )
        return F.when(F.exists(state["cells"], lambda c: (c["n"] != 0) | (c["k"] != 0)), gone).otherwise(state)

    start = F.struct(cells.alias("cells"), F.array().cast("array<bigint>").alias("out"))

    def end(state: Column) -> Column:
        left = F.exists(state["cells"], lambda c: (c["n"] != 0) | (c["k"] != 0) | (c["c"] != 0))
        return F.when(~left, state["out"])

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, end)


def fingerprint(digests: Column) -> Column:
    """The WIDTH table as text: its cells' counts and sums in hexadecimal, in order."""
    cell = lambda c: F.concat_ws(":", c["n"].cast("string"), F.hex(c["k"]), F.hex(c["c"]))
    return F.array_join(F.transform(table(digests, WIDTH), cell), " ")


def larger_differences(rows: DataFrame, key: list[str], tasks: int) -> DataFrame:
    """(key, differing): how many digests of ``rows(key, a, b)`` are in one of the two only,
    by larger tables, for rows whose first table has failed.

    The work is in the tables, not in bytes moved, so the number of ``tasks`` is given. The
    digests are dealt by their hash to parts of about PART, so that no table grows with
    the document; a part whose table fails is tried with the next width, and one that fails
    with all (less than one in a million) is compared digest by digest."""
    parts = F.greatest(F.lit(1), F.ceil((F.size("a") + F.size("b")) / PART))
    sides = F.concat(
        F.transform("a", lambda d: F.struct(d.alias("d"), F.lit(True).alias("left"))),
        F.transform("b", lambda d: F.struct(d.alias("d"), F.lit(False).alias("left"))),
    )
    dealt = (
        rows.select(*key, parts.alias("_parts"), F.explode(sides).alias("s"))
        .select(*key, F.pmod(F.xxhash64("s.d", F.lit(1)), F.col("_parts")).alias("_part"), "s.d", "s.left")
        .repartition(tasks, *key, "_part")
        .groupBy(*key, "_part")
        .agg(
            F.collect_list(F.when(F.col("left"), F.col("d"))).alias("a"),
            F.collect_list(F.when(~F.col("left"), F.col("d"))).alias("b"),
        )
    )
    for width in LARGER:
        tried = peeled(subtracted(table(F.col("a"), width), table(F.col("b"), width)), width)
        found = F.when(F.col("_found").isNull(), F.size(tried)) if width > LARGER[0] else F.size(tried)
        found = F.when(found >= 0, found)
        dealt = dealt.withColumn("_found", found if width == LARGER[0] else F.coalesce("_found", found))
    plain = F.size(F.array_except("a", "b")) + F.size(F.array_except("b", "a"))
    dealt = dealt.withColumn("_found", F.coalesce("_found", plain))
    return dealt.groupBy(*key).agg(F.sum("_found").alias("differing"))


def _half(n: Column) -> Column:
    return F.floor(n / 2).cast("int")


def with_next(docs: DataFrame) -> DataFrame:
    """(k1, k2, occ, doc_id, n_chars, next_doc_id, text, head, next): each row of ``docs(doc_id, text)``
    with the first half as many code points of the next document's text in descending doc_id
    (null last, then by hash; after the last the first), and that document's digests.

    The order is found on ids alone; a text is moved once to its key and the half that its
    neighbour needs once to the neighbour's. Rows equal in id and text are each other's
    next."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(
        "doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("k1"), F.xxhash64(text, "doc_id", F.lit(1)).alias("k2")
    )
    groups = keyed.groupBy("k1", "k2", "doc_id", F.char_length("text").alias("n")).agg(F.count("*").alias("copies"))
    ordered = stored(
        prefix_sums(groups, [F.desc_nulls_last("doc_id"), F.asc("k1"), F.asc("k2")], "copies").drop("before", "total")
    )
    count = ordered.count()
    target = ordered.select(
        F.col("k1").alias("t1"), F.col("k2").alias("t2"), F.col("n").alias("tn"), F.pmod(F.col("position") + 1, F.lit(max(1, count))).alias("position")
    )
    links = ordered.join(target, "position").select("k1", "k2", "copies", "t1", "t2", _half(F.col("tn")).alias("need"))
    same = Window.partitionBy("k1", "k2").orderBy("k1")
    # both uses of the join read the same columns, so that they share the texts' exchange
    moved = keyed.join(links, ["k1", "k2"])
    placed = moved.withColumn("occ", F.row_number().over(same))
    pieces = moved.select(
        F.col("t1").alias("k1"),
        F.col("t2").alias("k2"),
        F.col("doc_id").alias("next_doc_id"),
        F.expr("substring(text, 1, need)").alias("head"),
        paragraph_digests(F.col("text")).alias("next"),
    ).dropDuplicates(["k1", "k2"])
    repeated = F.col("occ") < F.col("copies")
    n = F.char_length("text")
    return placed.join(pieces, ["k1", "k2"]).select(
        "k1",
        "k2",
        "occ",
        "doc_id",
        "text",
        n.alias("n_chars"),
        F.when(repeated, F.col("doc_id")).otherwise(F.col("next_doc_id")).alias("next_doc_id"),
        F.when(repeated, F.substring("text", F.lit(1), _half(n))).otherwise(F.col("head")).alias("head"),
        F.when(repeated, paragraph_digests(F.col("text"))).otherwise(F.col("next")).alias("next"),
    )


def _likeness(differing: Column, a: Column, b: Column) -> Column:
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(1 - differing / total)


def compare_versions(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, next_doc_id) for every row of ``docs(doc_id, text)``.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many
    (or all) of the next document. Likeness is 1 less the share of differing digests in all
    digests of both; of two documents without paragraphs it is 1. A null text is empty. The
    differing digests come from subtracted fingerprints, and from larger tables where those
    fail to peel."""
    text, n, head = F.col("text"), F.col("n_chars"), F.col("head")
    edited = F.concat(F.substring(text, F.lit(1), n - _half(n)), head)
    versions = with_next(docs).select(
        "k1", "k2", "occ", "doc_id", "n_chars", "next_doc_id",
        F.sha2(edited, 256).alias("edited_sha256"),
        paragraph_digests(text).alias("a"),
        paragraph_digests(edited).alias("e"),
        F.col("next").alias("x"),
    )
    own = versions.withColumns({f"_{c}": table(F.col(c), WIDTH) for c in "aex"})
    tried = {f"d_{c}": F.size(peeled(subtracted(F.col("_a"), F.col(f"_{c}")), WIDTH)) for c in "ex"}
    key = ["k1", "k2", "occ"]
    base = stored(own.select(*key, "doc_id", "n_chars", "next_doc_id", "edited_sha256", "a", "e", "x", *(F.when(v >= 0, v).alias(k) for k, v in tried.items())))
    failed = base.filter("d_e IS NULL OR d_x IS NULL").select(
        *key, "a", F.explode(F.array(*(F.struct(F.lit(c).alias("to"), F.col(c).alias("b"), F.col(f"d_{c}").alias("d")) for c in "ex"))).alias("v")
    )
    failed = failed.filter("v.d IS NULL").select(*key, "v.to", "a", "v.b")
    tasks = max(1, -(-failed.count() // TASK_ROWS))
    larger = larger_differences(failed, [*key, "to"], tasks).groupBy(*key).agg(
        *(F.max(F.when(F.col("to") == c, F.col("differing"))).alias(f"l_{c}") for c in "ex")
    )
    a, e, x = F.col("a"), F.col("e"), F.col("x")
    return base.join(larger, key, "left").select(
        "doc_id",
        F.col("n_chars").cast("bigint").alias("n_chars"),
        "edited_sha256",
        fingerprint(a).alias("fingerprint"),
        fingerprint(e).alias("edited_fingerprint"),
        _likeness(F.coalesce("d_e", "l_e"), a, e).alias("near_edited"),
        _likeness(F.coalesce("d_x", "l_x"), a, x).alias("near_next"),
        "next_doc_id",
    )
