"""Runs of repeated words by internal pattern matching.

Words are numbered and the texts of a batch are joined, each closed by a number of its own. A
suffix array is built by doubling; the ranks of each round name all blocks of that power of
two. Each dyadic block is an interval of the array, and a wavelet tree over the array finds the
block's next occurrence before and behind it (range successor). The occurrences of a block of
size L within L places of it are one arithmetic progression, so its difference, the distance
of the nearest one, is the only period below L that the block can have; it is asked for those
from L / 2 on. The same ranks tell how far the period holds to both sides.

A run of four periods q or more holds an aligned block of the L in (q, 2 q], and a period to
one side of it, so every run is found, and by the nearest occurrence only with its smallest
period."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

#: A run has at least PERIODS periods and LEAST_WORDS words.
PERIODS, LEAST_WORDS = 4, 6
#: Words that are searched at once; a longer text is searched alone.
BATCH_WORDS = 1 << 17


class WaveletTree:
    """Numbers below ``2 ** bits``, a level for each bit from the highest down; a level has
    the numbers with a clear bit ahead of those with a set one, each in their former order."""

    def __init__(self, values: np.ndarray, bits: int):
        self._bits = range(bits - 1, -1, -1)
        self._clear: list[np.ndarray] = []  # clear bits ahead of each place
        for bit in self._bits:
            clear = values >> bit & 1 == 0
            self._clear.append(np.concatenate(([0], np.cumsum(clear))).astype(np.int32))
            values = np.concatenate((values[clear], values[~clear]))

    def below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many numbers at places ``low`` to ``high`` (exclusive) are below ``bound``."""
        found = np.zeros(len(low), np.int64)
        for bit, clear in zip(self._bits, self._clear, strict=True):
            up = bound >> bit & 1 == 1
            low0, high0, ones = clear[low], clear[high], clear[-1]
            found += np.where(up, high0 - low0, 0)
            low = np.where(up, ones + low - low0, low0)
            high = np.where(up, ones + high - high0, high0)
        return found

    def ranked(self, low: np.ndarray, high: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The number with ``rank`` smaller ones at places ``low`` to ``high`` (exclusive)."""
        value = np.zeros(len(low), np.int64)
        for bit, clear in zip(self._bits, self._clear, strict=True):
            low0, high0, ones = clear[low], clear[high], clear[-1]
            up = rank >= high0 - low0
            rank = np.where(up, rank - (high0 - low0), rank)
            low = np.where(up, ones + low - low0, low0)
            high = np.where(up, ones + high - high0, high0)
            value |= up.astype(np.int64) << bit
        return value


def _doubled(words: np.ndarray, longest: int) -> tuple[np.ndarray, list[np.ndarray], list[tuple[np.ndarray, ...]]]:
    """The suffix array as far as blocks of ``longest`` words tell; for each power of two up
    to it, the rank of the block at each place (the number of places with a smaller one); and
    for each the aligned blocks that occur again: place, and interval of the array."""
    n = len(words)
    order = np.argsort(words, kind="stable")
    new = np.concatenate(([True], words[order[1:]] != words[order[:-1]]))
    slot = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int32)
    rank[order] = slot
    ranks, blocks = [rank], []
    size = 1
    slots = np.arange(n)  # of the array, those whose block occurs more than once
    while True:
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(slots))
        many = np.repeat(ends - starts > 1, ends - starts)
        low, high = (np.repeat(slots[x], ends - starts)[many] for x in (starts, ends - 1))
        slots = slots[many]
        places = order[slots]
        if size > 1:
            aligned = places % size == 0
            blocks.append((places[aligned], low[aligned], high[aligned] + 1))
        if 2 * size > longest or not len(slots):
            break
        # the array is put in order by twice the words where it is not yet told apart; equal
        # blocks are in order of place already, and a stable sort leaves them so
        key = low * (n + 1) + rank[places + size]
        again = np.argsort(key, kind="stable")
        places, key = places[again], key[again]
        order[slots] = places
        new = np.concatenate(([True], key[1:] != key[:-1]))
        group = np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))
        rank = rank.copy()
        rank[places] = slots[group]
        ranks.append(rank)
        size *= 2
    return order, ranks, blocks


def _reach(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
    """How many words from ``a`` and ``b`` (a < b) on, or ahead of them, are equal."""
    total = np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        size, rank = 1 << k, ranks[k]
        going = np.arange(len(a))
        while len(going):
            x, y = (p[going] - total[going] - size if back else p[going] + total[going] for p in (a, b))
            there = (x >= 0) & (y < len(rank))
            same = np.zeros(len(going), bool)
            same[there] = rank[x[there]] == rank[y[there]]
            going = going[same]
            total[going] += size
            if k + 1 < len(ranks):
                break
    return total


def find_runs(words: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs of ``words``, by start, then period. ``longest`` is
    a bound for the length of a run."""
    none = np.zeros(0, np.int64)
    if longest < LEAST_WORDS:
        return none, none, none
    array, ranks, blocks = _doubled(words, longest // 2)
    if not sum(len(b[0]) for b in blocks):
        return none, none, none
    place, low, high = (np.concatenate([b[i] for b in blocks]) for i in range(3))
    size = np.repeat([2 << k for k in range(len(blocks))], [len(b[0]) for b in blocks])
    tree = WaveletTree(array, int(len(words)).bit_length())
    rank = tree.below(low, high, place)
    first, period = [], []
    for step in (1, -1):
        has = (rank + step >= 0) & (rank + step < high - low)
        other = tree.ranked(low[has], high[has], rank[has] + step)
        distance = np.abs(other - place[has])
        good = (2 * distance >= size[has]) & (distance < size[has])
        first.append(np.minimum(other, place[has])[good])
        period.append(distance[good])
    pairs = np.unique(np.stack((np.concatenate(first), np.concatenate(period))), axis=1)
    a, q = pairs
    start = a - _reach(ranks, a, a + q, back=True)
    length = a + q + _reach(ranks, a, a + q, back=False) - start
    good = length >= np.maximum(LEAST_WORDS, PERIODS * q)
    runs = np.unique(np.stack((start[good], q[good], length[good])), axis=1)
    return runs[0], runs[2], runs[1]


def _runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The (start, length, period) of each text's runs."""
    numbers: dict[bytes, int] = {}
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))
    words = np.empty(int(starts[-1]), np.int64)
    for at, text in zip(starts[:-1].tolist(), texts, strict=True):
        words[at : at + len(text)] = [numbers.setdefault(w, len(numbers)) for w in text]
    words[starts[1:] - 1] = len(numbers) + np.arange(len(texts))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    found = find_runs(words, int(sizes.max(initial=0)))
    of = np.searchsorted(starts, found[0], "right") - 1
    for i, start, length, period in zip(of.tolist(), *(x.tolist() for x in found), strict=True):
        out[i].append((start - int(starts[i]), length, period))
    return out


def _batches(texts: list[bytes]) -> Iterator[list[list[bytes]]]:
    """Words of texts, about BATCH_WORDS at once."""
    some, size = [], 0
    for text in texts:
        words = text.split()  # of bytes: at 0x20 and 0x09 to 0x0D
        if some and size + len(words) > BATCH_WORDS:
            yield some
            some, size = [], 0
        some.append(words)
        size += len(words)
    yield some


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    return b" ".join([words[i] for i in kept.tolist()])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in batches:
        texts = [t or b"" for t in batch.column("text").to_pylist()]
        number = {t: i for i, t in enumerate(dict.fromkeys(texts))}  # copies are searched once
        at = 0
        distinct = list(number)
        which = np.array([number[t] for t in texts], np.int64)
        for words in _batches(distinct):
            runs = _runs_of(words)
            collapsed = [_collapsed(w, r) for w, r in zip(words, runs, strict=True)]
            rows = np.flatnonzero((which >= at) & (which < at + len(words)))
            local = (which[rows] - at).tolist()
            columns = [
                batch.column("doc_id").take(pa.array(rows)),
                pa.array([len(words[i]) for i in local], pa.int64()),
                pa.array([[{"start": s, "length": n, "period": q} for s, n, q in runs[i]] for i in local], run_type),
                pa.array([collapsed[i] for i in local], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])
            at += len(words)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for each row of ``docs(doc_id, text)``.

    A run is a longest stretch of words with smallest period q, of at least PERIODS * q and
    LEAST_WORDS words; ``runs`` holds (start, length, period) by start, then period, starts
    counted in words from 0. ``collapsed`` is the text's words joined by one space without
    those that a run holds after its first q words. A null or empty text has no words, no runs
    and an empty ``collapsed``; rows that repeat a doc_id or a text each get their row; an
    empty table gives no rows. Each text is searched whole, in its own row's task; memory
    grows with BATCH_WORDS or the longest text, whichever is more."""
    run = StructType([StructField(c, LongType()) for c in ("start", "length", "period")])
    schema = StructType(
        [
            StructField("doc_id", docs.schema["doc_id"].dataType),
            StructField("n_words", LongType()),
            StructField("runs", ArrayType(run)),
            StructField("collapsed", BinaryType()),
        ]
    )
    found = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_search, schema)
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))
