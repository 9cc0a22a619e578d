"""Packing of token sequences by non-negative least squares over length combinations.

Each document is cut into whole windows and a remainder. Of all pairs and triples of lengths
that fill a window, non-negative least squares finds how often each should be used so that
the histogram of remainders is met; the counts are rounded down, what they leave is packed
greedily into exact combinations, and what fits into none runs in one stream that is cut at
window ends. The end of the stream is cut into powers of two, which need no padding."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from srcmetrics.llm.bpe import byte_symbols
from srcmetrics.llm.sharding import prefix_sums
from srcmetrics.llm.store import bounded, stored

WINDOW, END_ID = 2048, 1
#: Rounds of the least squares, columns looked at in each, and the relative gain that ends it.
ROUNDS, LOOKED_AT, LEAST_GAIN = 300, 4096, 1e-5
#: Words, and parts of late and of before, kept with their ids in a Python worker; of words, those
#: of so many symbols at most.
MEMORY_WORDS, LONGEST_KEPT = 600_000, 64
#: Rows that are worked on at once, and bytes of ids after which pieces are handed on.
SLICE_ROWS, BATCH_BYTES = 512, 8 << 20
_RANK_BITS = 44


def _letters_and_mark(part: str) -> tuple[str, str]:
    """A word of letters and the full stop or comma after it, if any; else nothing."""
    mark = part[-1:] if part[-1:] in (".", ",") else ""
    letters = part[:-1] if mark else part
    return (letters, mark) if letters.isalpha() else ("", "")


class TokenIds:
    """Ids of whole texts as the tokenizers library gives them, without added tokens.

    A byte-level vocabulary merges within words only, and a space between two characters that
    are no white space always begins a word. Such texts are cut at these spaces; the parts that
    are not in memory are cut into words and merged by the library's own steps. Texts with
    special strings, and other kinds of vocabularies, are encoded whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self._tokenizer.to_str())
        cut = spec["pre_tokenizer"] or {}
        self._by_words = (
            cut.get("type") == "ByteLevel"
            and cut.get("use_regex", True)
            and not cut["add_prefix_space"]
            and not spec["normalizer"]
            and spec["model"]["type"] == "BPE"
            and not spec["model"].get("dropout")
        )
        self._added = [t["content"] for t in spec["added_tokens"]]
        self.dtype = "<u2" if self._tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self._cut, self._merge = self._tokenizer.pre_tokenizer, self._tokenizer.model
        self._letters = byte_symbols()
        self._space, self._line_feed = self._letters[ord(" ")], self._letters[ord("\n")]
        self._code = "H" if self.dtype == "<u2" else "I"
        self._words: dict[str, bytes] = {}
        #: Parts after a space, those of late and those of before.
        self._parts: dict[str, bytes] = {}
        self._old_parts: dict[str, bytes] = {}

    def _word(self, symbols: str) -> bytes:
        ids = self._words.get(symbols)
        if ids is None:
            if len(self._words) >= MEMORY_WORDS:
                self._words.clear()
            ids = self._merged(symbols)
            if len(symbols) <= LONGEST_KEPT:
                self._words[symbols] = ids
        return ids

    def _merged(self, symbols: str) -> bytes:
        return array(self._code, [t.id for t in self._merge.tokenize(symbols)]).tobytes()

    def _symbols(self, letters: str) -> str:
        return letters if letters.isascii() else letters.encode().decode("latin-1").translate(self._letters)

    def _spaced(self, letters: str) -> bytes:
        """A word of letters after a space."""
        ids = self._parts.get(letters)
        if ids is None:
            ids = self._old_parts.get(letters)
            if ids is None:
                ids = self._merged(self._space + self._symbols(letters))
            self._parts[letters] = ids
        return ids

    def _part(self, part: str) -> bytes:
        """A part that begins with a space, which is not in it."""
        letters, mark = _letters_and_mark(part)
        if letters:
            return self._spaced(letters) + self._word(mark) if mark else self._spaced(letters)
        # one line feed between characters that are no white space is a word of its own
        head, _, tail = part.partition("\n")
        letters, mark = _letters_and_mark(tail)
        if letters and _letters_and_mark(head)[0]:
            ids = self._part(head) + self._word(self._line_feed) + self._word(self._symbols(letters))
            return ids + self._word(mark) if mark else ids
        return self._plain(f" {part}")

    def _plain(self, text: str) -> bytes:
        return b"".join([self._word(w) for w, _ in self._cut.pre_tokenize_str(text)]) if text else b""

    def __call__(self, text: str) -> bytes:
        """The ids of a text, one after another in ``dtype``."""
        if not self._by_words or any(a in text for a in self._added):
            return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        # a space between white space is not cut at: there the run of white space is one word
        parts = re.split(r"(?<=\S) (?=\S)", text) if re.search(r"\s (?:\s|\Z)", text) else text.split(" ")
        memory = self._parts
        before, passing = self._old_parts, []
        for part in set(parts[1:]).difference(memory):
            ids = before.get(part)
            if ids is None:
                ids = self._merged(self._space + self._symbols(part)) if part.isalpha() else self._part(part)
            memory[part] = ids
            if "\n" in part:  # the ends of two lines seldom meet again; their words are kept
                passing.append(part)
        out = self._plain(parts[0]) + b"".join([memory[p] for p in parts[1:]])
        for part in passing:
            del memory[part]
        if len(memory) > MEMORY_WORDS:
            self._old_parts, self._parts = memory, {}
        return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


@lru_cache(2)
def _token_ids(path: str) -> TokenIds:
    return TokenIds(path)


def combinations(window: int, present: np.ndarray) -> np.ndarray:
    """All pairs and triples of ``present`` lengths that fill a window: rows (a, b, c) with
    a <= b <= c, a = 0 for pairs."""
    there = np.zeros(window + 1, bool)
    there[present] = True
    there[0] = False
    rows = []
    for a in (0, *present[(present > 0) & (present <= window // 3)]):
        b = np.arange(max(a, 1), (window - a) // 2 + 1)
        b = b[there[b] & there[window - a - b]]
        rows.append(np.stack((np.full(len(b), a), b, window - a - b), axis=1))
    return np.concatenate(rows).astype(np.int64)


def least_squares(counts: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Repeats x >= 0 of the combinations for which the lengths they use are nearest to
    ``counts`` in the sum of squares.

    Coordinate descent in blocks: each round takes the combinations by the gain of their best
    step, those that share no length with a better one, and makes these steps at once, as
    they do not touch one another."""
    x = np.zeros(len(columns))
    if not len(columns):
        return x
    left = counts.astype(float)
    left[0] = 0
    a, b, c = columns.T
    norm = (a > 0) + 2.0 + 2.0 * ((a == b) + (b == c)) + 2.0 * (a == c)
    total = float(left @ left)
    for _ in range(ROUNDS):
        slope = left[a] + left[b] + left[c]
        step = np.maximum(slope / norm, -x)
        gain = step * (2 * slope - step * norm)
        best = np.argpartition(-gain, LOOKED_AT)[:LOOKED_AT] if len(gain) > LOOKED_AT else np.arange(len(gain))
        best = best[np.argsort(-gain[best], kind="stable")]
        used, chosen = set(), []
        for j, lengths in zip(best.tolist(), columns[best].tolist(), strict=True):
            if gain[j] <= 0:
                break
            if used.isdisjoint(lengths):
                used.update(k for k in lengths if k)
                chosen.append(j)
        if not chosen or gain[chosen].sum() <= LEAST_GAIN * total:
            break
        x[chosen] += step[chosen]
        np.subtract.at(left, columns[chosen], step[chosen, None])
        left[0] = 0
    return x


def _uses(columns: np.ndarray, repeats: np.ndarray, window: int) -> np.ndarray:
    used = np.bincount(columns.ravel(), np.repeat(repeats, columns.shape[1]), minlength=window + 1)
    used = np.rint(used).astype(np.int64)
    used[0] = 0
    return used


def plan_windows(counts: np.ndarray, window: int) -> dict[tuple[int, int, int], int]:
    """How often each combination of lengths is used. ``counts[n]`` is the number of
    remainders of length n; no length is used more often than that."""
    present = np.flatnonzero(counts)
    columns = combinations(window, present[(present > 0) & (present < window)])
    repeats = np.floor(least_squares(counts, columns)).astype(np.int64)
    columns, repeats = columns[repeats > 0], repeats[repeats > 0]
    # least squares may use a length too often: take combinations back, the rarest first
    used = _uses(columns, repeats, window)
    for length in np.flatnonzero(used > counts):
        holds = (columns == length).sum(axis=1)
        for j in np.flatnonzero(holds)[np.argsort(repeats[holds > 0], kind="stable")].tolist():
            over = int(used[length] - counts[length])
            if over <= 0:
                break
            back = min(int(repeats[j]), -(-over // int(holds[j])))
            repeats[j] -= back
            np.subtract.at(used, columns[j], back)
    plan = {tuple(c): n for c, n in zip(columns.tolist(), repeats.tolist(), strict=True) if n}
    # what is left: the longest first, with the longest ones that fill the window
    rest = counts - _uses(columns, repeats, window)
    rest[0] = 0
    for length in range(window - 1, 0, -1):
        for b in range(min(length, window - length), -1, -1):
            c = window - length - b
            if c > b or not rest[length]:
                break
            if (b and not rest[b]) or (c and not rest[c]):
                continue
            parts = tuple(sorted((length, b, c)))
            need = {k: parts.count(k) for k in parts if k}
            times = min(int(rest[k]) // m for k, m in need.items())
            if times:
                plan[parts] = plan.get(parts, 0) + times
                for k, m in need.items():
                    rest[k] -= m * times
    return plan


@dataclass(frozen=True)
class Layout:
    """Where remainders go: the k-th of a length, or a place in the stream."""

    window: int
    key: np.ndarray  # length << _RANK_BITS | first rank, ascending
    sequence: np.ndarray  # sequence of that rank
    offset: np.ndarray
    stream_base: int
    stream_ends: tuple[int, ...]  # ends of the sequences beyond the stream's last whole window
    full_base: int

    def slot(self, length: int, rank: int) -> tuple[int, int]:
        key = length << _RANK_BITS | rank
        j = int(np.searchsorted(self.key, key, "right")) - 1
        return int(self.sequence[j]) + key - int(self.key[j]), int(self.offset[j])

    def stream(self, at: int, length: int) -> Iterator[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of the pieces of ``length`` ids at ``at``."""
        whole = self.stream_ends[0]
        start = 0
        while start < length:
            place = at + start
            if place < whole:
                number, offset = divmod(place, self.window)
                end = place - offset + self.window
            else:
                k = next(i for i, e in enumerate(self.stream_ends) if e > place)
                number, offset = whole // self.window + k - 1, place - self.stream_ends[k - 1]
                end = self.stream_ends[k]
            size = min(length - start, end - place)
            yield start, size, self.stream_base + number, offset
            start += size


def layout(counts: np.ndarray, window: int) -> tuple[Layout, np.ndarray]:
    """The layout and, for each length, how many remainders have a slot in a combination."""
    slots: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for parts, times in sorted(plan_windows(counts, window).items()):
        offset = 0
        for length in reversed(parts):
            if length:
                slots.setdefault(length, []).append((times, sequence, offset))
                offset += length
        sequence += times
    stock = np.zeros(window + 1, np.int64)
    rows = []
    for length in sorted(slots):
        for times, first, offset in slots[length]:
            rows.append((length << _RANK_BITS | int(stock[length]), first, offset))
            stock[length] += times
    key, first, offset = np.array(rows, np.int64).reshape(-1, 3).T
    stream = int(((counts - stock)[1:] * np.arange(1, len(counts))).sum())
    ends = [stream // window * window]
    for bit in range(window.bit_length(), -1, -1):
        if stream % window & 1 << bit:
            ends.append(ends[-1] + (1 << bit))
    full_base = sequence + ends[0] // window + len(ends) - 1
    return Layout(window, key, first, offset, sequence, tuple(ends), full_base), stock


def _tokenise(path: str, window: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _token_ids(path)
        end, width = np.array([end_id], ids_of.dtype).tobytes(), np.dtype(ids_of.dtype).itemsize
        part, row, full = TaskContext.get().partitionId(), 0, 0
        seen = [0] * window
        for batch in _slices(batches):
            ids, n, rank, before = [], [], [], []
            for text in batch.column("text").to_pylist():
                data = (ids_of(text) if text else b"") + end
                ids.append(data)
                n.append(len(data) // width)
                rest = n[-1] % window
                rank.append(seen[rest])
                seen[rest] += 1
                before.append(full)
                full += n[-1] // window
            size = len(n)
            columns = [
                pa.array(np.full(size, part, np.int32)),
                pa.array(np.arange(row, row + size)),
                batch.column("doc_id"),
                pa.array(n, pa.int64()),
                pa.array(rank, pa.int64()),
                pa.array(before, pa.int64()),
                pa.array(ids, pa.binary()),
            ]
            row += size
            yield pa.RecordBatch.from_arrays(columns, ["part", "row", "doc_id", "n", "rank", "full_before", "ids"])

    return run


def _cut(path: str, plan: Layout):
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = _token_ids(path).dtype
        for batch in _slices(batches):
            column = {c: batch.column(c).to_pylist() for c in ("n", "rank", "full", "at", "ids")}
            rows, ids, out, held = [], [], [], 0
            for i, (n, rank, full, at, data) in enumerate(zip(*column.values(), strict=True)):
                wide = np.frombuffer(data, dtype).astype("<u4").tobytes()
                whole, rest = divmod(n, plan.window)
                pieces = [(k * plan.window, plan.window, plan.full_base + full + k, 0) for k in range(whole)]
                if rest and at is None:
                    pieces.append((whole * plan.window, rest, *plan.slot(rest, rank)))
                elif rest:
                    pieces += [(whole * plan.window + s, *p) for s, *p in plan.stream(at, rest)]
                for start, length, sequence, offset in pieces:
                    rows.append(i)
                    ids.append(wide[4 * start : 4 * (start + length)])
                    out.append((start, length, n, sequence, offset))
                held += len(wide)
                if held > BATCH_BYTES or i + 1 == batch.num_rows:
                    start, length, tokens, sequence, offset = (pa.array(c, pa.int64()) for c in zip(*out, strict=True))
                    doc_id = batch.column("doc_id").take(pa.array(rows, pa.int64()))
                    columns = [doc_id, start, length, pa.array(ids, pa.binary()), tokens, sequence, offset]
                    yield pa.RecordBatch.from_arrays(columns, names)
                    rows, ids, out, held = [], [], [], 0

    return run


def pack_documents(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): pieces of the token ids
    of ``docs(doc_id, text)`` and their places in sequences of at most ``window`` ids.

    A document's ids are those of the tokenizer file at ``path`` (which every executor must
    have) and ``end_id``; a null or empty text has the end alone. ``ids`` holds a piece's ids
    as unsigned 32-bit integers, low byte first. Each id is in one piece. All sequences are
    full but the stream's last ones, whose sizes are powers of two (if ``window`` is one, no
    padding at all is needed). Rows that repeat a doc_id are packed each for itself; an empty
    table gives no rows. Only the histogram of remainders, which has as many numbers as a
    window has ids, reaches the driver."""
    doc_id = StructField("doc_id", docs.schema["doc_id"].dataType)
    fields = [StructField("part", IntegerType()), StructField("row", LongType()), doc_id]
    fields += [StructField(c, LongType()) for c in ("n", "rank", "full_before")] + [StructField("ids", BinaryType())]
    tokens = stored(docs.select("doc_id", "text").mapInArrow(_tokenise(path, window, end_id), StructType(fields)))
    tokens = tokens.withColumn("rest", F.col("n") % window)
    heads = tokens.select("part", "row", "n", "rest", "rank")

    by_part = heads.groupBy("part", "rest").agg(F.count("*").alias("rows"), F.sum(F.expr(f"n div {window}")).alias("full"))
    by_part = stored(by_part)
    counts = np.zeros(window + 1, np.int64)
    for rest, rows in by_part.groupBy("rest").agg(F.sum("rows")).collect():  # at most one row a length
        counts[rest] = rows
    counts[0] = 0
    plan, stock = layout(counts, window)

    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = by_part.select(
        "part", "rest", F.coalesce(F.sum("rows").over(ahead.partitionBy("rest")), F.lit(0)).alias("rank_ahead")
    )
    fulls = by_part.groupBy("part").agg(F.sum("full").alias("full"))  # one row per partition
    fulls = fulls.select("part", F.coalesce(F.sum("full").over(ahead), F.lit(0)).alias("full_ahead"))
    ranks = stored(ranks)
    stocks = docs.sparkSession.createDataFrame([(k, int(s)) for k, s in enumerate(stock)], "rest bigint, stock bigint")
    ranks = bounded(ranks, 64)
    over = (
        heads.filter("rest > 0")
        .join(ranks, ["part", "rest"])
        .join(F.broadcast(stocks), "rest")  # one row per length
        .filter("rank + rank_ahead >= stock")
        .select("part", "row", "rest")
    )
    streamed = stored(prefix_sums(over, ["part", "row"], "rest").select("part", "row", F.col("before").alias("at")))
    placed = (
        tokens.join(ranks, ["part", "rest"])
        .join(F.broadcast(fulls), "part")
        .join(bounded(streamed.withColumnsRenamed({"part": "p", "row": "r"}), 64), F.expr("part = p AND row = r"), "left")
        .select(
            "doc_id",
            "n",
            (F.col("rank") + F.col("rank_ahead")).alias("rank"),
            (F.col("full_before") + F.col("full_ahead")).alias("full"),
            "at",
            "ids",
        )
    )
    fields = [doc_id, StructField("start", LongType()), StructField("length", LongType()), StructField("ids", BinaryType())]
    fields += [StructField(c, LongType()) for c in ("doc_tokens", "sequence_id", "offset")]
    return placed.mapInArrow(_cut(path, plan), StructType(fields))
