"""Benchmark decontamination: size-partitioned MinHash containment search for short test
items in long documents, verified by exact shingle containment.

Items are partitioned by the size of their shingle sets, class u holding sizes above u / 2 up
to u. For each class the shingles of the documents, in text order, are cut into blocks of u;
any two neighbouring blocks are a window, so an item's place in a text lies in one window
whole. At a containment c the Jaccard similarity of item and window is then at least
c / 2 / (2 + (1 - c) / 2), whatever the document's length, and HASHES is taken so that all
minimum hashes differ with a probability of at most MISS. A window and an item that share a
minimum hash are a candidate; the document's and the item's whole shingle sets decide.
Blocks of twice the size are pairs of blocks, so all classes come from one pass."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcmetrics.llm.shingles import PLAIN, shingles, text_slices, words
from srcmetrics.llm.store import bounded, stored

SHINGLE, CONTAINMENT, MISS = 5, 0.8, 1e-3
HASHES = math.ceil(math.log(MISS) / math.log(1 - CONTAINMENT / 2 / (2 + (1 - CONTAINMENT) / 2)))
#: Bytes of item texts that are searched for in one pass over the documents; more are
#: searched in as many passes.
BLOCK_BYTES = 8 << 20
_FACTORS = np.random.default_rng(5).integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TOP = np.uint64(2**64 - 1)
_FOUND = "doc_id bigint, item int, n_shared int"


class Items:
    """The shingle sets of a block of items, and for each class and hash the minima with
    their items in ascending order."""

    def __init__(self, texts: list[str]):
        self.sets: list[np.ndarray] = []
        for _, end, data, rows in text_slices(pa.array(texts, pa.string())):
            found, owner = shingles(*words(data, rows, PLAIN), SHINGLE)
            first = np.searchsorted(owner, np.arange(len(rows)))
            self.sets += [np.unique(found[a:b]) for a, b in zip(first, first[1:], strict=False)]
            assert len(self.sets) == end
        level = [max(0, math.ceil(math.log2(len(s)))) if len(s) else -1 for s in self.sets]
        self.index: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for k in sorted({x for x in level if x >= 0}):
            items = np.array([i for i, x in enumerate(level) if x == k])
            minima = np.array([(_FACTORS[:, None] * self.sets[i]).min(axis=1) for i in items])
            orders = np.argsort(minima, axis=0)
            self.index[k] = [(minima[orders[:, j], j], items[orders[:, j]]) for j in range(HASHES)]


def _candidates(stream: np.ndarray, items: Items) -> Iterator[tuple[int, int, int]]:
    """(item, begin, end) of the windows of a shingle stream that share a minimum hash."""
    highest = max(items.index, default=-1)
    for j in range(HASHES):
        low = stream * _FACTORS[j]
        for k in range(highest + 1):
            if k in items.index:
                window = np.minimum(low, np.append(low[1:], _TOP))
                values, owner = items.index[k][j]
                at = np.searchsorted(values, window)
                for w in np.flatnonzero(values[np.minimum(at, len(values) - 1)] == window):
                    same = at[w]
                    while same < len(values) and values[same] == window[w]:
                        yield int(owner[same]), int(w) << k, int(w + 2) << k
                        same += 1
            if len(low) % 2:
                low = np.append(low, _TOP)
            low = np.minimum(low[0::2], low[1::2])


def _matches(texts: pa.Array, items: Items) -> Iterator[tuple[int, int, int]]:
    """(row, item, shared shingles) of the items found in each text, by row and item."""
    for at, _, data, rows in text_slices(texts):
        stream, owner = shingles(*words(data, rows, PLAIN), SHINGLE)
        if not len(stream):
            continue
        pairs: set[tuple[int, int]] = set()
        for item, begin, end in _candidates(stream, items):
            pairs.update((int(row), item) for row in np.unique(owner[begin:end]))
        for row, item in sorted(pairs):
            a, b = np.searchsorted(owner, (row, row + 1))
            shared = int(np.isin(items.sets[item], stream[a:b]).sum())
            if shared >= CONTAINMENT * len(items.sets[item]):
                yield at + row, item, shared


def _search(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            found = [(ids[row].as_py(), item, shared) for row, item, shared in _matches(batch.column("text"), items)]
            if found:
                kinds = (pa.int64(), pa.int32(), pa.int32())
                columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item", "n_shared"])

    return run


def _without(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            clean[[row for row, *_ in _matches(batch.column("text"), items)]] = False
            yield batch.filter(pa.array(clean))

    return run


def _item_blocks(items: DataFrame) -> Iterator[tuple[list, Items]]:
    """Rows and index of blocks of about BLOCK_BYTES of items."""
    items = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    passes = max(1, math.ceil(size / BLOCK_BYTES))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(passes))
    for k in range(passes):
        rows = items.filter(part == k).collect()
        yield rows, Items([r.text for r in rows])


def find_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared): the items of ``items(item_id, text)`` of which
    at least CONTAINMENT of the distinct shingles are in a text of ``docs(doc_id, text)``.

    Shingles are of five plain words (ASCII letters and digits and all of non-ASCII, A-Z
    lower-cased). An item of fewer words is one shingle, which only a text of the same words
    has; an item or a text that is null or without words is never found. Repeated rows of
    either side are found each. The items are few or are searched for in blocks of
    BLOCK_BYTES, each a pass over the documents; the documents stay where they are read."""
    spark = docs.sparkSession
    frames: list[DataFrame] = []
    for rows, block in _item_blocks(items):
        known = spark.createDataFrame(
            [(i, r.item_id, len(s)) for i, (r, s) in enumerate(zip(rows, block.sets, strict=True))],
            "item int, item_id bigint, n_shingles int",
        )
        found = docs.select("doc_id", "text").mapInArrow(_search(block), _FOUND)
        found = found.join(F.broadcast(known), "item").select("doc_id", "item_id", "n_shingles", "n_shared")
        if frames:
            frames = [stored(f) for f in frames]
            found = stored(found)
        frames.append(found)
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` in whose text no item is found, with all their columns; also rows
    without an id, and each of several texts of one id, are told by their own text. Documents
    are left out where they are read: no text and no id is shuffled."""
    for _, block in _item_blocks(items):
        docs = docs.mapInArrow(_without(block), docs.schema)
    return docs
