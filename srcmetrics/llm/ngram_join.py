"""N-gram Jaccard join by vertical partitioning.

The order of all n-grams is cut into fragments. In each fragment the n-grams of all documents
meet, and what the fragment knows of a document or a pair is a partial count; the parts are
summed per document or pair:

1. Every document's n-gram set is cut by fragment. A fragment tells which n-grams occur in
   more than one set; a document whose shared n-grams, summed over fragments, are fewer than
   the threshold asks for can have no partner and leaves. What travels is a few bytes for
   each n-gram, and an n-gram frequent in one block of documents travels once for the block.
2. The documents left, one for each distinct set, are ordered by global n-gram frequency. A
   pair over the threshold shares an n-gram of both prefixes; sizes and parity bitmaps drop
   candidates exactly.
3. Candidates get their overlap fragment by fragment, summed per pair, and are held against
   the threshold.

Sets are compared by 64-bit n-gram hashes (``shingles``). Components need not list all pairs
of a group: each frequent n-gram first compares its documents with a few pivots; only pairs
whose documents are then still apart are compared one by one, so no link between two
components is missed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcmetrics.llm.linking import linked_components
from srcmetrics.llm.shingles import mix, shingle_sets
from srcmetrics.llm.store import bounded, stored

#: N-grams and documents of a block, and n-grams of a fragment, about.
BLOCK_NGRAMS, BLOCK_DOCS, FRAGMENT_NGRAMS = 1 << 20, 60_000, 1 << 19
#: Rows that a block hands on at once.
BATCH_ROWS = 1 << 10
#: Fragments (a power of two, as bits) in which overlaps of pairs are counted.
PAIR_FRAGMENT_BITS = 1
#: Stands for "several documents of the block" in place of a document's number.
_SEVERAL = 0xFFFF
SetsOf = Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]
NODE = ["node", "n", "b0", "b1", "b2", "b3"]
_PARTS = "frag bigint, block bigint, ngrams binary, docs binary"
_COUNTED = "doc_id bigint, sid bigint, n int, shared bigint"
_LISTED = "doc_id bigint, members array<bigint>"
_HIT = np.dtype([("doc", "<u2"), ("member", "<u8")])
_DOC = np.dtype([("id", "<i8"), ("valid", "?"), ("sid", "<u8"), ("n", "<i4"), ("shared", "<i8")])


def _set_ids(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit identity of each set, and its size."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)))))
    n = np.diff(first)
    return mix(sums[first[1:]] - sums[first[:-1]] + n.astype(np.uint64)), n.astype(np.int32)


def _binary(*rows: tuple) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, ["frag", "block", "ngrams", "docs"])


def _hits(docs: np.ndarray, members: np.ndarray) -> np.ndarray:
    hits = np.empty(len(docs), _HIT)
    hits["doc"], hits["member"] = docs, members
    return hits


def _cut(bits: int, block: int, docs: np.ndarray, hashes: list, owners: list, lists: bool = False) -> Iterator[pa.RecordBatch]:
    """A block's rows: one for each fragment with the block's distinct n-grams and their
    document, and one (fragment below 0) with the documents and what they share within: its
    number or, for ``lists``, all of it."""
    h, owner = np.concatenate(hashes), np.concatenate(owners)
    order = np.argsort(h)
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    run = np.cumsum(new) - 1
    several = (np.bincount(run) > 1) if len(h) else np.zeros(0, bool)
    docs["shared"] = np.bincount(owner[several[run]], minlength=len(docs))
    within = _hits(owner[several[run]], h[several[run]] >> np.uint64(16)).tobytes() if lists else None
    owner = np.where(several, _SEVERAL, owner[new]).astype("<u2")
    h = h[new] >> np.uint64(16)
    yield _binary((-1 - block, block, docs.tobytes(), within))
    if not len(h):
        return
    frag = h >> np.uint64(48 - bits)
    begin = np.flatnonzero(np.diff(frag, prepend=frag[0] + np.uint64(1)))  # only fragments that the block has
    steps = np.diff(h, prepend=h[0])
    steps[begin] = h[begin] - (frag[begin] << np.uint64(48 - bits))
    wide = np.maximum.reduceat(steps, begin) >= 1 << 32
    narrow, end = steps.astype("<u4"), np.append(begin[1:], len(h))
    rows = [
        (f, block, (steps if w else narrow)[a:b].tobytes(), owner[a:b].tobytes())
        for f, w, a, b in zip(frag[begin].tolist(), wide.tolist(), begin.tolist(), end.tolist(), strict=True)
    ]
    for at in range(0, len(rows), BATCH_ROWS):
        yield _binary(*rows[at : at + BATCH_ROWS])


def _blocks(sets_of: SetsOf, bits: int, lists: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        docs: list = []
        hashes: list = []
        owners: list = []
        n_docs = n_grams = 0
        for ids, valid, h, first in (part for batch in batches for part in sets_of(batch)):
            if n_docs and (n_docs + len(ids) > BLOCK_DOCS or n_grams + len(h) > BLOCK_NGRAMS):
                yield from _cut(bits, block, np.concatenate(docs), hashes, owners, lists)
                docs, hashes, owners, n_docs, n_grams = [], [], [], 0, 0
                block += 1
            own = np.zeros(len(ids), _DOC)
            own["id"], own["valid"] = ids, valid
            own["sid"], own["n"] = _set_ids(h, first)
            docs.append(own)
            hashes.append(h)
            owners.append(np.repeat(np.arange(n_docs, n_docs + len(ids)), np.diff(first)))
            n_docs, n_grams = n_docs + len(ids), n_grams + len(h)
        if n_docs:
            yield from _cut(bits, block, np.concatenate(docs), hashes, owners, lists)

    return run


def _in_fragment(bits: int, lists: bool = False):
    def run(table: pa.Table) -> pa.Table:
        """Which documents of each block have an n-gram of this fragment that is shared, and,
        for ``lists``, which one."""
        frag = table["frag"][0].as_py()
        if frag < 0:
            return table
        sizes, grams, owners = [], [], []
        for steps, own in zip(table["ngrams"].to_pylist(), table["docs"].to_pylist(), strict=True):
            own = np.frombuffer(own, "<u2")
            steps = np.frombuffer(steps, "<u4" if len(steps) == 4 * len(own) else "<u8")
            grams.append(np.cumsum(steps, dtype=np.uint64))
            owners.append(own)
            sizes.append(len(own))
        h, owner = np.concatenate(grams), np.concatenate(owners)
        block = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(h)
        h, owner, block = h[order], owner[order], block[order]
        same = h[1:] == h[:-1]
        run_of = np.concatenate(([0], np.cumsum(~same)))
        count = np.bincount(run_of)
        known = np.zeros(len(count), bool)
        known[run_of[owner == _SEVERAL]] = True
        hit = (known | (count > 1))[run_of] & (owner != _SEVERAL)
        owner, block = owner[hit], block[hit]
        order = np.argsort(block, kind="stable")
        owner, edges = owner[order].astype("<u2"), np.searchsorted(block[order], np.arange(len(sizes) + 1))
        if lists:
            owner = _hits(owner, h[hit][order] + (np.uint64(frag) << np.uint64(48 - bits)))
        parts = [owner[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)]
        return pa.table({"frag": table["frag"], "block": table["block"], "ngrams": pa.nulls(len(sizes), pa.binary()), "docs": pa.array(parts, pa.binary())}, schema=table.schema)

    return run


def _summed(table: pa.Table) -> pa.Table:
    """A block's documents with their shared n-grams summed over the fragments."""
    lists = table["ngrams"].to_pylist()
    docs = np.frombuffer(next(x for x in lists if x is not None), _DOC)
    shared = docs["shared"].copy()
    for part in table["docs"].to_pylist():
        if part:
            shared += np.bincount(np.frombuffer(part, "<u2"), minlength=len(docs))
    return pa.table(
        {
            "doc_id": pa.array(docs["id"], pa.int64(), mask=~docs["valid"]),
            "sid": docs["sid"].view("<i8"),
            "n": docs["n"],
            "shared": shared,
        }
    )


def _listed(table: pa.Table) -> pa.Table:
    """A block's documents that share members, with all of those."""
    docs = np.frombuffer(next(x for x in table["ngrams"].to_pylist() if x is not None), _DOC)
    hits = np.concatenate([np.zeros(0, _HIT), *(np.frombuffer(x, _HIT) for x in table["docs"].to_pylist() if x)])
    hits = hits[np.argsort(hits["doc"], kind="stable")]
    some, begin = np.unique(hits["doc"], return_index=True)
    offsets = pa.array(np.append(begin, len(hits)), pa.int32())
    members = pa.ListArray.from_arrays(offsets, pa.array(hits["member"].view("<i8")))
    return pa.table({"doc_id": pa.array(docs["id"][some], pa.int64(), mask=~docs["valid"][some]), "members": members})


def shared_lists(rows: DataFrame, sets_of: SetsOf, members: int) -> DataFrame:
    """(doc_id, members): the members, as the upper 48 bits of their hashes, of each row's set
    that are also in another row's set, or twice in its own; rows without any are left out.
    Arguments as in ``shared_members``."""
    bits = max(0, (members // FRAGMENT_NGRAMS).bit_length())
    parts = rows.mapInArrow(_blocks(sets_of, bits, True), _PARTS)
    parts = parts.groupBy("frag").applyInArrow(_in_fragment(bits, True), _PARTS)
    return parts.groupBy("block").applyInArrow(_listed, _LISTED)


def shared_members(rows: DataFrame, sets_of: SetsOf, members: int) -> DataFrame:
    """(doc_id, sid, n, shared): identity and size of each row's set, and how many of its
    members are also in another row's set (at least; a clash of 48-bit hashes may add one).
    ``sets_of`` gives (ids, their validity, members' hashes, first index of each id) of a
    batch; ``members`` is about their number in all."""
    bits = max(0, (members // FRAGMENT_NGRAMS).bit_length())
    parts = rows.mapInArrow(_blocks(sets_of, bits), _PARTS)
    parts = parts.groupBy("frag").applyInArrow(_in_fragment(bits), _PARTS)
    return parts.groupBy("block").applyInArrow(_summed, _COUNTED)


def shared_ngrams(docs: DataFrame, size: int) -> DataFrame:
    """``shared_members`` of the n-gram sets of ``docs(doc_id, text)``."""

    def sets_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        ids = batch.column("doc_id")
        valid, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        for at, end, h, first in shingle_sets(batch.column("text"), size):
            yield ids[at:end], valid[at:end], h, first

    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return shared_members(docs.select("doc_id", "text"), sets_of, total // 6)


def _fragments(size: int):
    shift = np.uint64(64 - PAIR_FRAGMENT_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, h, first in shingle_sets(batch.column("text"), size):
                sid, n = _set_ids(h, first)
                row = np.repeat(np.arange(end - at), n)
                parity = np.bincount(row * 256 + (h & np.uint64(255)).astype(np.int64), minlength=256 * (end - at)) & 1
                maps = np.packbits(parity.astype(bool)).view("<i8").reshape(-1, 4)
                key = row << PAIR_FRAGMENT_BITS | (h >> shift).astype(np.int64)
                begin = np.flatnonzero(np.diff(key, prepend=-1))
                rows = key[begin] >> PAIR_FRAGMENT_BITS
                offsets = np.append(begin, len(h)).astype(np.int32)
                columns = [
                    pa.array(sid.view("<i8")[rows]),
                    pa.array(n[rows]),
                    pa.array((key[begin] & ((1 << PAIR_FRAGMENT_BITS) - 1)).astype(np.int32)),
                    *(pa.array(maps[rows, k]) for k in range(4)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(h.view("<i8"))),
                ]
                names = ["node", "n", "frag", "b0", "b1", "b2", "b3", "ngrams"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _over(pct: int, same: str, na: str, nb: str) -> str:
    return f"100 * ({same}) >= {pct} * ({na} + {nb} - ({same}))"


def _verified(pairs: DataFrame, pieces: DataFrame, pct: int) -> DataFrame:
    """The pairs over the threshold: overlaps counted per fragment and summed per pair."""
    pairs = stored(pairs)  # a plan of its own: the driver keeps a plan and its stages until it ends
    left = pieces.select(F.col("node").alias("a"), "frag", F.col("n").alias("na"), F.col("ngrams").alias("ga"))
    right = pieces.select(F.col("node").alias("b"), "frag", F.col("n").alias("nb"), F.col("ngrams").alias("gb"))
    partial = (
        pairs.join(left, "a").join(right, ["b", "frag"])
        .select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).alias("same"))
    )
    summed = partial.groupBy("a", "b", "na", "nb").agg(F.sum("same").alias("same"))
    return stored(summed.filter(_over(pct, "same", "na", "nb")).select("a", "b"))


def _may_link(pct: int, x: str, y: str) -> str:
    """Exact bounds. Sets that differ in d n-grams have bitmaps that differ in d bits at most;
    at the first n-gram that two sets share in the global order, all others they share are
    among the ``rest`` after it."""
    bits = " + ".join(f"bit_count({x}.b{k} ^ {y}.b{k})" for k in range(4))
    return (
        f"100 * least({x}.n, {y}.n) >= {pct} * greatest({x}.n, {y}.n)"
        f" AND {100 + pct} * (1 + least({x}.rest, {y}.rest)) >= {pct} * ({x}.n + {y}.n)"
        f" AND {100 + pct} * ({bits}) <= {100 - pct} * ({x}.n + {y}.n)"
    )


def ngram_components(docs: DataFrame, size: int, pct: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs(doc_id, text)``.

    Two documents link when their sets of ``size``-word n-grams have a Jaccard similarity of
    ``pct`` percent or more; component_id is the smallest doc_id that links reach. A text
    with fewer words is one n-gram; a text that is null or has no words has none and is
    linked with nothing. Rows that repeat a doc_id count as rows. Null ids are never a
    component's id unless all of it has none. An empty table gives no rows."""
    found = stored(shared_ngrams(docs, size))
    left = found.filter(f"n > 0 AND 100 * shared >= {pct} * n")
    classes = stored(left.groupBy("sid").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    reps = classes.select(F.col("rep").alias("doc_id"))
    chosen = docs.join(bounded(reps, 16), "doc_id", "left_semi").select("text")
    pieces = stored(
        chosen.mapInArrow(
            _fragments(size),
            "node bigint, n int, frag int, b0 bigint, b1 bigint, b2 bigint, b3 bigint, ngrams array<bigint>",
        )
    )
    nameless = stored(classes.filter("rep IS NULL").select(F.col("sid").alias("node")))
    if not nameless.isEmpty():  # sets that only rows without an id have
        unnamed = docs.filter("doc_id IS NULL").select("text").mapInArrow(_fragments(size), pieces.schema)
        pieces = stored(pieces.unionByName(unnamed.join(bounded(nameless, 16), "node", "left_semi")))
    if pieces.count() != pieces.select("node", "frag").distinct().count():  # a doc_id repeats
        pieces = stored(pieces.dropDuplicates(["node", "frag"]))

    least = f"(({pct} * n + 99) div 100)"
    grams = pieces.select("node", "n", F.explode("ngrams").alias("gram"))
    frequent = grams.groupBy("gram").agg(F.count("*").alias("df")).filter("df > 1")
    of_node = Window.partitionBy("node")
    prefix = (
        grams.join(frequent, "gram")
        .withColumn("kept", F.count("*").over(of_node))
        .withColumn("place", F.row_number().over(of_node.orderBy("df", "gram")))
        .filter(f"place <= kept - {least} + 1")
        .select("gram", "node", (F.col("kept") - F.col("place")).alias("rest"))
    )
    about = pieces.groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", "b0", "b1", "b2", "b3")))
    prefix = stored(prefix.join(about, "node"))

    keys = prefix.select(F.col("gram").alias("key"), *NODE, "rest", F.lit(True).alias("index"))
    roots = linked_components(
        keys, [*NODE[1:], "rest"], lambda x, y: _may_link(pct, x, y), lambda pairs: _verified(pairs, pieces, pct)
    )

    grouped = classes.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    least_id = grouped.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = stored(grouped.join(least_id, "root").select("sid", "component_id"))
    return found.join(bounded(named, 24), "sid", "left").select(
        "doc_id",
        F.col("n").cast("bigint").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
