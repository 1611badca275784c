"""Token counts by heap-and-linked-list byte-pair merging (operator 9).

A text is cut by the byte-level pre-tokenizer's pattern; in each piece the lowest-rank adjacent pair
is merged again and again, with a heap for the order and a doubly linked list for the neighbours.
The count is the number of initial byte symbols minus the number of merges; no identifiers are made.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .shared import map_texts

#: Fixed value: the pre-tokenizer pattern of byte-level BPE files whose ``use_regex`` is true.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Distinct chunks of text whose counts a Python worker remembers before it starts afresh.
REMEMBERED = 400_000

_SHIFT = 32
_POSITION = (1 << _SHIFT) - 1


class Merges:
    """Merge rules of a byte-level BPE file, and the texts of its added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        before, model = file.get("pre_tokenizer") or {}, file["model"]
        if model["type"] != "BPE" or before.get("type") != "ByteLevel" or not before.get("use_regex", True):
            raise ValueError("a byte-level BPE file is needed")
        if file.get("normalizer") or before.get("add_prefix_space") or model.get("ignore_merges"):
            raise ValueError("normalizers, prefix spaces and ignore_merges are not supported")
        added = file.get("added_tokens") or []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens must be plain strings")
        self.special = sorted((t["content"] for t in added), key=len, reverse=True)
        vocabulary = model["vocab"]
        self.symbol = [vocabulary[c] for c in byte_alphabet()]
        self.pairs: list[tuple[int, int]] = []
        self.made: list[int] = []
        for rule in model["merges"]:
            left, right = rule if isinstance(rule, list) else rule.split(" ")
            self.pairs.append((vocabulary[left], vocabulary[right]))
            self.made.append(vocabulary[left + right])


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: bytes that print stand for themselves,
    the others get code points from 256 up in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class Counter(dict):
    """Counts tokens.  As a dict: the count of each chunk met, where a chunk stands between two
    single spaces (the one before it included); None marks chunks that need their surroundings."""

    def __init__(self, merges: Merges):
        self.symbol, self.made = merges.symbol, merges.made
        self.of_rank = [a << 24 | b for a, b in merges.pairs]
        self.rank: dict[int, int] = {}
        for r, key in enumerate(self.of_rank):
            self.rank.setdefault(key, r)
        self.find = regex.compile(PATTERN).findall
        self.special = merges.special
        self.cut = regex.compile("|".join(map(regex.escape, merges.special))).split if merges.special else None

    def piece(self, data: bytes) -> int:
        """Symbols left of one pre-token after all merges."""
        left = len(data)
        at = [self.symbol[b] for b in data]
        rank = self.rank.get
        heap = []
        for i in range(left - 1):
            if (r := rank(at[i] << 24 | at[i + 1])) is not None:
                heap.append(r << _SHIFT | i)
        if not heap:
            return left
        heapq.heapify(heap)
        end = left
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        while heap:
            top = heapq.heappop(heap)
            i, r = top & _POSITION, top >> _SHIFT
            j = after[i]
            if j >= end or at[i] < 0 or at[i] << 24 | at[j] != self.of_rank[r]:
                continue  # one of the two has been merged since
            at[i], at[j] = self.made[r], -1
            k = after[i] = after[j]
            left -= 1
            if k < end:
                before[k] = i
                if (r := rank(at[i] << 24 | at[k])) is not None:
                    heapq.heappush(heap, r << _SHIFT | i)
            h = before[i]
            if h >= 0 and (r := rank(at[h] << 24 | at[i])) is not None:
                heapq.heappush(heap, r << _SHIFT | h)
        return left

    def plain(self, text: str) -> int:
        """Tokens of a text by the pattern alone."""
        return sum(self.piece(w.encode()) for w in self.find(text))

    def __missing__(self, chunk: str) -> float:
        # A single space between two characters that aren't white space always starts a token.
        found = float("nan") if not chunk or chunk[0].isspace() or chunk[-1].isspace() else self.plain(" " + chunk)
        if len(chunk) < 200:
            if len(self) >= REMEMBERED:
                self.clear()
            self[chunk] = found
        return found

    def ordinary(self, text: str) -> int:
        """Tokens of a text without added tokens."""
        if not text:
            return 0
        first, *chunks = text.split(" ")
        if first and not first[-1].isspace():
            total = sum(map(self.__getitem__, chunks))
            if total == total:
                return self.plain(first) + int(total)
        return self.plain(text)

    def count(self, text: str) -> int:
        if self.cut is None or not any(s in text for s in self.special):
            return self.ordinary(text)
        parts = self.cut(text)
        return sum(map(self.ordinary, parts)) + len(parts) - 1


_workers: dict[str, Counter] = {}


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` for each row of ``docs``, in no order.

    Null texts count as empty (0 bytes, 0 tokens); null ids and repeated rows pass through; other
    columns are not read; an empty table gives an empty result.  The tokenizer file is read on the
    driver and its merge table, whose size does not depend on the data, is broadcast.  Rows are
    handled one by one without a shuffle, so skew and lost executors cost a task at most.
    """
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(Merges(tokenizer_path))
    key = tokenizer_path

    def step(batch: pa.RecordBatch) -> dict:
        if key not in _workers:
            _workers[key] = Counter(shipped.value)
        texts = [t or "" for t in batch.column(1).to_pylist()]
        tokens = list(map(_workers[key].count, texts))
        return {
            id_col: batch.column(0),
            "n_bytes": [len(t.encode()) for t in texts],
            "n_tokens": tokens,
            "over_limit": [n > limit for n in tokens],
        }

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs.select(id_col, text_col), text_col, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean", step)


def brute_count(pieces: Iterable[bytes], merges: Merges) -> int:
    """The same count by scanning for the lowest-rank pair again and again; for tests."""
    rank = {p: r for r, p in reversed(list(enumerate(merges.pairs)))}
    total = 0
    for data in pieces:
        at = [merges.symbol[b] for b in data]
        while len(at) > 1:
            r, i = min((rank.get(p, 1 << 30), i) for i, p in enumerate(zip(at, at[1:], strict=False)))
            if r == 1 << 30:
                break
            at[i : i + 2] = [merges.made[r]]
        total += len(at)
    return total
