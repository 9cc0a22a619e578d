"""Components of all links among rows that share keys, without listing a group's pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from srcmetrics.llm.components import components
from srcmetrics.llm.shingles import mix
from srcmetrics.llm.store import bounded, stored

#: Rows of a key that all its rows are held against in a round, and rounds.
PIVOTS, ROUNDS = 8, 2
#: Rows of whole keys, and pairs of them, that a Python worker holds at once, about.
GROUP_ROWS, GROUP_PAIRS = 1 << 16, 1 << 19


def linked_components(
    keys: DataFrame,
    attributes: list[str],
    may_link: Callable,
    verified: Callable[[DataFrame], DataFrame],
    grouped: bool = False,
) -> DataFrame:
    """(node, root) of all nodes with a link.

    ``keys``: key, node, the node's attributes and ``index``; any two linked nodes share a
    key at which one of them has ``index``. ``may_link(x, y)`` is an SQL condition on the
    attributes that every link meets; ``verified`` keeps the links of pairs (a, b).

    In each of ROUNDS rounds the rows of a key are held against PIVOTS of them, chosen by
    hash, that are in other components as yet, and the verified links are joined to
    components. Then rows of a key whose nodes are still in different components are held
    against each other. So every link is found or lies within one component, and a group of
    alike rows costs a few pairs each.

    ``grouped``: a key's rows meet in a Python worker, and ``may_link(x, y)`` takes and gives
    arrays (``x(name)`` are the values of an attribute). Pivots leave their key after the round."""
    if grouped:
        return _grouped_components(keys, attributes, may_link, verified)
    ends = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.max("index").alias("some"))
    shared = stored(ends.filter("low <> high AND some").select("key"))
    keys = stored(keys.join(bounded(shared, 16), "key", "left_semi"))
    fields = ["node", *attributes, "root"]
    roots = None
    for turn in range(ROUNDS):
        rooted = _rooted(keys, roots)
        pivots = _carried(rooted, fields, range(turn * PIVOTS, (turn + 1) * PIVOTS))
        near = F.expr("x.root <> p.root AND " + may_link("x", "p"))
        tried = rooted.alias("x").join(pivots, "key").filter(near)
        pairs = tried.select(F.least("x.node", "p.node").alias("a"), F.greatest("x.node", "p.node").alias("b"))
        roots = _joined(roots, verified(pairs.distinct()))

    rooted = _rooted(keys, roots)
    x, y = rooted.filter("index").alias("x"), rooted.alias("y")
    apart = F.expr("x.node <> y.node AND (NOT y.index OR x.node < y.node) AND x.root <> y.root AND " + may_link("x", "y"))
    rest = x.join(y, (F.col("x.key") == F.col("y.key")) & apart)
    pairs = rest.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    return _joined(roots, verified(pairs.distinct()))


def _grouped_components(keys: DataFrame, attributes: list[str], may_link: Callable, verified: Callable) -> DataFrame:
    names = ["key", "node", *attributes, "index"]
    kinds = StructType([keys.schema[c] for c in names]).add("other", LongType())
    roots = None
    for turn in range(ROUNDS + 1):
        met = _rooted(keys.select(names), roots).repartition("key").sortWithinPartitions("key")
        found = stored(met.mapInArrow(_meet(names, may_link, PIVOTS if turn < ROUNDS else None), kinds))
        pairs = found.filter("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b"))
        roots = _joined(roots, verified(pairs.distinct()))
        keys = found.filter("other IS NULL")
        if keys.isEmpty():
            break
    return roots


def _meet(names: list[str], may_link: Callable, pivots: int | None) -> Callable:
    """Takes rows in the order of their keys. Of each key, gives the pairs (node, other) of its
    first ``pivots`` rows by hash with those after them (None: of all rows), and then the other
    rows if they are in several components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        size, enough = 0, GROUP_ROWS
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append({c: batch.column(c).to_numpy(zero_copy_only=False) for c in [*names, "root"]})
            size += batch.num_rows
            if size < enough:
                continue
            rows = {c: np.concatenate([x[c] for x in held]) for c in held[0]}
            cut = int(np.searchsorted(rows["key"], rows["key"][-1]))  # the last key may go on
            yield from _of_groups({c: x[:cut] for c, x in rows.items()}, batch.schema)
            held, size = [{c: x[cut:] for c, x in rows.items()}], size - cut
            enough = max(GROUP_ROWS, 2 * size)
        if size:
            yield from _of_groups({c: np.concatenate([x[c] for x in held]) for c in held[0]}, batch.schema)

    def _of_groups(rows: dict[str, np.ndarray], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((mix(rows["node"].view(np.uint64)), rows["key"]))
        rows = {c: x[order] for c, x in rows.items()}
        rows, begin, size = _open(rows)
        rank = np.arange(len(begin)) - begin
        count = rank if pivots is None else np.minimum(rank, pivots)
        # each row meets the pivots before it, so many pairs at once
        ends = np.cumsum(count)
        found = [np.zeros((2, 0), np.int64)]
        at = 0
        while at < len(ends):
            done = int(ends[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(ends, done + GROUP_PAIRS, "right")))
            some = count[at:end]
            x = np.repeat(np.arange(at, end), some)
            y = np.arange(len(x)) + np.repeat(begin[at:end] - (ends[at:end] - some - done), some)
            apart = (rows["root"][x] != rows["root"][y]) & (rows["index"][x] | rows["index"][y])
            x, y = x[apart], y[apart]
            near = may_link(lambda c, x=x: rows[c][x], lambda c, y=y: rows[c][y])
            x, y = rows["node"][x[near]], rows["node"][y[near]]
            found.append(_different(np.stack((np.minimum(x, y), np.maximum(x, y)))))
            at = end
        a, b = _different(np.concatenate(found, axis=1))
        if len(a):
            given = {"node": pa.array(a), "other": pa.array(b)}
            columns = [given[c] if c in given else pa.nulls(len(a), schema.field(c).type) for c in [*names, "other"]]
            yield pa.RecordBatch.from_arrays(columns, [*names, "other"])
        if pivots is not None:
            rest, *_ = _open({c: x[rank >= pivots] for c, x in rows.items()})
            n = len(rest["key"])
            if n:
                yield pa.RecordBatch.from_arrays([*(pa.array(rest[c]) for c in names), pa.nulls(n, pa.int64())], [*names, "other"])

    return run


def _different(pairs: np.ndarray) -> np.ndarray:
    """The pairs (columns) without repeats."""
    pairs = pairs[:, np.lexsort(pairs)]
    new = np.ones(pairs.shape[1], bool)
    new[1:] = (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)
    return pairs[:, new]


def _open(rows: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The rows of keys with several components and an index row; where each one's key begins,
    and how many rows it has."""
    if len(rows["key"]):
        begin = np.flatnonzero(np.concatenate(([True], rows["key"][1:] != rows["key"][:-1])))
        size = np.diff(np.append(begin, len(rows["key"])))
        root = rows["root"]
        wanted = np.logical_or.reduceat(rows["index"], begin) & (np.minimum.reduceat(root, begin) != np.maximum.reduceat(root, begin))
        rows = {c: x[np.repeat(wanted, size)] for c, x in rows.items()}
        size = size[wanted]
    else:
        size = np.zeros(0, np.int64)
    return rows, np.repeat(np.cumsum(size) - size, size), np.repeat(size, size)


def _carried(rooted: DataFrame, fields: list[str], seeds: range) -> DataFrame:
    """(key, p): the row of each key with the least hash, for each of ``seeds``."""
    least = [F.min(F.struct(F.xxhash64("node", F.lit(s)).alias("h"), *fields)).alias(f"p{s}") for s in seeds]
    plain = [F.struct(*(F.col(f"p{s}.{c}").alias(c) for c in fields)) for s in seeds]
    return rooted.groupBy("key").agg(*least).select("key", F.explode(F.array_distinct(F.array(*plain))).alias("p"))


def _rooted(keys: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return keys.withColumn("root", F.col("node"))
    return keys.join(bounded(roots, 24), "node", "left").withColumn("root", F.coalesce("root", "node"))


def _joined(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components of the links and of the components so far."""
    if roots is None:
        return components(links)
    if links.isEmpty():
        return roots
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links))
