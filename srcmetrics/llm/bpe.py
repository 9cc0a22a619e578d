"""Token counts of byte-level byte-pair vocabularies, without emitting tokens."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words kept with their counts in a Python worker; the memory is emptied when it is full.
MEMORY_WORDS = 400_000
#: Longer texts are cut into words one at a time.
LONG_TEXT = 1_000_000


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: the
    byte's own where that is visible, else the next one from 256 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordCounts(dict):
    """Tokens per word, computed when a word is first asked for.

    The symbols of a word form a doubly linked list, and every adjacent pair that the
    vocabulary merges waits in a heap under (rank, position). The lowest is popped, merged in
    place and the pairs with its neighbours pushed; pairs whose symbols have changed since
    are skipped. The count is the number of bytes less the number of merges."""

    def __init__(self, merges: list[tuple[str, str]]):
        super().__init__()
        symbol = byte_symbols()
        names: dict[str, int] = {}
        self._byte = [names.setdefault(symbol[b], len(names)) for b in range(256)]
        self._merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            pair = names.setdefault(a, len(names)), names.setdefault(b, len(names))
            self._merge[pair] = rank, names.setdefault(a + b, len(names))

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMORY_WORDS:
            self.clear()
        count = self.count(word.encode())
        if len(word) <= 64:
            self[word] = count
        return count

    def count(self, data: bytes) -> int:
        merge = self._merge
        symbols = [self._byte[b] for b in data]
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [
            (merge[p][0], i, p) for i in range(n - 1) if (p := (symbols[i], symbols[i + 1])) in merge
        ]
        heapq.heapify(heap)
        merged = 0
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if j >= n or (symbols[i], symbols[j]) != pair:
                continue
            symbols[i], symbols[j] = merge[pair][1], -1
            after[i] = k = after[j]
            merged += 1
            if k < n:
                before[k] = i
                p = symbols[i], symbols[k]
                if p in merge:
                    heapq.heappush(heap, (merge[p][0], i, p))
            if (h := before[i]) >= 0:
                p = symbols[h], symbols[i]
                if p in merge:
                    heapq.heappush(heap, (merge[p][0], h, p))
        return n - merged


class Counter:
    """Counts the tokens of whole texts as the tokenizer file defines them."""

    #: Fixed value: the words that byte-level vocabularies merge within.
    WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, cut = spec["model"], spec["pre_tokenizer"]
        plain = cut["type"] == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"]
        if model["type"] != "BPE" or not plain or spec["normalizer"] or model["ignore_merges"]:
            raise ValueError(f"not a plain byte-level vocabulary: {path}")
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self._counts = WordCounts(merges)
        self._words = regex.compile(self.WORD)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self._special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def _piece(self, text: str) -> int:
        if len(text) < LONG_TEXT:
            return sum(map(self._counts.__getitem__, self._words.findall(text)))
        return sum(self._counts[m[0]] for m in self._words.finditer(text))

    def count(self, text: str) -> int:
        """Tokens of a text; each special string in it is one token."""
        if self._special is None or not self._special.search(text):
            return self._piece(text)
        pieces = self._special.split(text)
        return sum(map(self._piece, pieces)) + len(pieces) - 1


@lru_cache(2)
def _counter(path: str) -> Counter:
    return Counter(path)


def token_count(text: Column, path: str) -> Column:
    """Tokens of a text (bigint; null counts as empty) under the byte-level byte-pair
    vocabulary file at ``path``, which every executor must have. Nothing is truncated."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(path)
        for texts in batches:
            yield pd.Series([counter.count(t) for t in texts], dtype="int64")

    return count(F.coalesce(text, F.lit("")))
