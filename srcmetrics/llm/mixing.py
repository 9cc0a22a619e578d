"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcmetrics.llm.store import bounded, stored

#: Fixed value: the golden ratio's fractional part.
GOLDEN = 0.6180339887498949
#: Slots of the schedule; a block has the mix's tokens divided by this, at least one token.
SLOTS = 1 << 21
#: Slots that each source has at least; one with a smaller target has smaller blocks, and at
#: less than a token a slot takes several slots for a token.
SOURCE_SLOTS = 1 << 10
#: Rows of a source, and slots, that one task puts in order; more are cut by hash or number.
CHUNK_DOCS, CHUNK_SLOTS = 1 << 11, 1 << 14
#: Cells of the unit interval by which slots find their source.
CELLS = 1 << 12


def word_count(text: Column) -> Column:
    """Words (runs of other than space and 0x09-0x0D); null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _ahead(rows: DataFrame, group: list[str], chunk: str, order: list[str], size: Column) -> DataFrame:
    """Adds ``start``: the sum of ``size`` of the rows ahead in the group, by (chunk, order).
    Only the rows of one chunk meet in a task; chunks add up by their totals."""
    rows = rows.withColumn("_size", size)
    before = Window.partitionBy(*group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*group, chunk)
        .agg(F.sum("_size").alias("_total"))
        .withColumn("_offset", F.coalesce(F.sum("_total").over(before), F.lit(0)))
        .drop("_total")
    )
    own = Window.partitionBy(*group, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("_own", F.coalesce(F.sum("_size").over(own), F.lit(0)))
        .join(offsets, [*group, chunk])
        .withColumn("start", F.col("_offset") + F.col("_own"))
        .drop("_offset", "_own", "_size")
    )


def source_targets(
    sizes: DataFrame, weights: Sequence[float], share: float, most: float
) -> DataFrame:
    """(source, rank, source_rows, source_size, target) of ``sizes(source, size)``.

    Sources by code point, null last, take ``weights`` in turn. They share ``share`` of all
    sizes by weight; a target stops at ``most`` times its source's size, and the excess is
    shared anew by weight among the others until none is above. Sources without words get
    target 0."""
    totals = sizes.groupBy("source").agg(F.count("*").alias("source_rows"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    totals = stored(
        totals.withColumn("rank", F.row_number().over(order) - 1)
        .withColumn("weight", F.get(cycle, (F.col("rank") % len(weights)).cast("int")))
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
    )
    full = F.lit(False)
    level = 0.0
    while True:  # ends: each round caps at least one more source
        free = F.when(~full, F.col("weight"))
        capped = F.when(full, F.col("cap"))
        pool, used, open_weight = totals.agg(F.sum("source_size"), F.sum(capped), F.sum(free)).first()
        if not open_weight:
            break
        new = ((pool or 0) * share - (used or 0.0)) / open_weight
        grown = totals.filter(~full & (F.col("cap") <= F.col("weight") * new)).limit(1).count()
        level = new
        if not grown:
            break
        full = F.col("cap") <= F.col("weight") * F.lit(new)
    target = F.when(full, F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.lit(level)))
    return totals.withColumn("target", target).drop("weight", "cap")


def source_blocks(sources: DataFrame, block: int) -> DataFrame:
    """Adds ``block``, the tokens of the source's blocks, ``every``, the slots that it is dealt
    for each of them, and ``share``, what it has of the schedule: its target, or more as its
    blocks are smaller than ``block``."""
    own = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.col("target") / SOURCE_SLOTS))).cast("bigint")
    every = F.when(F.col("target") > 0, F.greatest(F.lit(1), F.ceil(SOURCE_SLOTS / F.col("target"))))
    sized = sources.withColumn("block", own).withColumn("every", F.coalesce(every, F.lit(1)).cast("bigint"))
    return sized.withColumn("share", F.col("target") * (F.lit(float(block)) / F.col("block")) * F.col("every"))


def schedule(sources: DataFrame, slots: int) -> DataFrame:
    """(slot, rank, turn): the source that each of ``slots`` slots takes from, and the slot's
    number among that source's, from 0.

    Slot i has the point i * golden ratio modulo 1; its source is the one in whose part of
    the cumulative shares the point falls, found by an equi-join on cells of the interval."""
    upto = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    parts = (
        sources.filter("target > 0")
        .withColumn("_pool", F.sum("share").over(everything))
        .withColumn("_to", F.sum("share").over(upto) / F.col("_pool"))
        .withColumn("_to", F.when(F.col("rank") == F.max("rank").over(everything), 1.0).otherwise(F.col("_to")))
        .withColumn("_from", F.coalesce(F.lag("_to").over(Window.orderBy("rank")), F.lit(0.0)))
        .withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_from") * CELLS), F.floor(F.col("_to") * CELLS))))
        .select("rank", "_from", "_to", "_cell")
    )
    turned = F.col("id") * F.lit(GOLDEN)
    points = (
        sources.sparkSession.range(slots)
        .withColumn("_point", turned - F.floor(turned))
        .withColumn("_cell", F.floor(F.col("_point") * CELLS))
    )
    placed = (
        points.join(bounded(stored(parts), 40), "_cell")
        .filter("_point >= _from AND _point < _to")
        .select(F.col("id").alias("slot"), "rank", F.floor(F.col("id") / CHUNK_SLOTS).alias("_chunk"))
    )
    turns = _ahead(placed, ["rank"], "_chunk", ["slot"], F.lit(1))
    return turns.select("slot", "rank", F.col("start").alias("turn"))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: int = 2,
    slots: int = SLOTS,
    seed: int = 17,
) -> tuple[DataFrame, DataFrame]:
    """(documents, blocks): what a mix of ``docs(doc_id, source, size)`` takes.

    Each source's documents are shuffled by a seeded hash into one stream of tokens, cut into
    equal blocks (the last is shorter): the pool's tokens by ``slots``, or fewer in a source
    whose target would have less than SOURCE_SLOTS of them. The golden-ratio schedule deals
    slots to sources by their targets in blocks; a source's turn t stands for its block t modulo
    its number of blocks, so later turns repeat the stream from its start; turns beyond ``most``
    passes are left out. So each source is within a few blocks, or a few in a thousand, of its
    target, at every size of the corpus.
    ``documents``: doc_id, source, size, source_size, target and taken, the tokens of the
    document in the blocks dealt, repeats counted. ``blocks``: slot, rank of the source,
    block and pass. Equal inputs give equal mixes on any cluster. Documents without words
    take 0, repeated rows count each, a null source is a source, an empty table gives none."""
    docs = stored(docs.select("doc_id", "source", "size"))
    sources = source_targets(docs, weights, share, most)
    pool = sources.agg(F.sum("target")).first()[0] or 0.0
    block = max(1, math.ceil(pool / slots))
    sources = stored(source_blocks(sources, block))
    shares = sources.agg(F.sum("share")).first()[0] or 0.0

    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    spread = F.conv(F.substring(F.md5(F.encode(named, "UTF-8")), 1, 8), 16, 10).cast("bigint")
    known = sources.select(F.col("source").alias("_source"), "rank", "source_rows", "source_size", "target", F.col("block").alias("_block"))
    placed = (
        docs.join(bounded(known, 96), F.expr("source <=> _source"))
        .withColumn("_hash", spread)
        .withColumn("_chunk", F.expr(f"_hash * ceil(source_rows / {CHUNK_DOCS}) div {1 << 32}L"))
        .drop("_source", "source_rows")
    )
    empty = placed.filter("size = 0").drop("_hash", "_chunk", "rank", "_block").withColumn("taken", F.lit(0).cast("bigint"))
    # documents and slots are put in order by plans of their own: all stages of a plan that can
    # run are held by the driver at once
    stream = stored(_ahead(placed.filter("size > 0"), ["rank"], "_chunk", ["_hash", "doc_id", "size"], F.col("size")).drop("_hash", "_chunk"))
    pieces = stream.withColumn(
        "block", F.explode(F.sequence(F.expr("start div _block"), F.expr("(start + size - 1) div _block")))
    ).withColumn(
        "_words", F.expr("least((block + 1) * _block, start + size) - greatest(block * _block, start)")
    )

    lengths = sources.select("rank", "every", F.expr("(source_size + block - 1) div block").alias("_blocks"))
    dealt = (
        schedule(sources, math.ceil(shares / block))
        .join(bounded(lengths, 24), "rank")
        .filter("turn % every = 0")
        .withColumn("turn", F.expr("turn div every"))
        .filter(F.col("turn") < most * F.col("_blocks"))
        .select("slot", "rank", F.expr("turn % _blocks").alias("block"), F.expr("turn div _blocks").alias("pass"))
    )
    times = stored(dealt.groupBy("rank", "block").agg(F.count("*").alias("_times")))
    taken = (
        pieces.join(times, ["rank", "block"], "left")
        .groupBy("rank", "start", "doc_id", "source", "size", "source_size", "target")
        .agg(F.sum(F.col("_words") * F.coalesce("_times", F.lit(0))).alias("taken"))
        .drop("rank", "start")
    )
    return taken.unionByName(empty), dealt
