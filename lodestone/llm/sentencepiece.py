"""SentencePiece encoding and decoding (operator 1).

An Aho-Corasick automaton over the pieces runs once over a text; at each position it follows output
links through all pieces that end there, longest first, and each relaxes the best score of a
segmentation up to that position (Viterbi).  The best path is read back from the end.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import SMALL_BYTES, map_texts

#: Stands for a space within pieces.
SPACE = "▁"
#: Stands for that very sign in a text, so that decoding gives it back: no text holds a surrogate.
_LITERAL = "\ud800"
#: Distinct chunks of text whose pieces a Python worker remembers before it starts afresh.
REMEMBERED = 200_000
#: What an unknown character scores below the lowest piece.
UNKNOWN_PENALTY = 10.0
_NORMAL, _UNKNOWN, _USER, _BYTE = 1, 2, 4, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol buffer message's fields."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[i]
            value |= (byte & 127) << shift
            i, shift = i + 1, shift + 7
            if byte < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        else:
            n, i = varint(i) if kind == 2 else (8 if kind == 1 else 4, i)
            value, i = data[i : i + n], i + n
        yield key >> 3, value


class Pieces:
    """The pieces of a ``.model`` file: texts, scores and kinds by identifier."""

    def __init__(self, path: str):
        self.text: list[str] = []
        self.score: list[float] = []
        self.kind: list[int] = []
        prefix, fallback = True, False
        with open(path, "rb") as f:
            data = f.read()
        for number, value in _fields(data):
            part = dict(_fields(value)) if number in (1, 2, 3) else {}
            if number == 1:
                self.text.append(part[1].decode())
                self.score.append(struct.unpack("<f", part[2])[0] if 2 in part else 0.0)
                self.kind.append(part.get(3, _NORMAL))
            elif number == 2:
                fallback = bool(part.get(35, 0))
                if part.get(24, 0):
                    raise ValueError("white space as a suffix is not supported")
            elif number == 3:
                prefix = bool(part.get(3, 1))
                if part.get(2) or part.get(4, 1):
                    raise ValueError("only models that leave texts as they are can be decoded exactly")
        if not fallback:
            raise ValueError("a model with byte fallback is needed, so that every text can be decoded")
        self.prefix = prefix
        bytes_ = {t: i for i, t in enumerate(self.text) if self.kind[i] == _BYTE}
        self.of_byte = [bytes_[f"<0x{b:02X}>"] for b in range(256)]

    def usable(self) -> Iterator[tuple[str, int, float]]:
        for i, (t, s, k) in enumerate(zip(self.text, self.score, self.kind, strict=True)):
            if k in (_NORMAL, _USER):
                yield t, i, s


class Coder(dict):
    """Encodes and decodes.  As a dict: the identifiers of each chunk met, as 4-byte integers; a
    chunk starts at a space sign that follows another sign, which no piece reaches across."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        usable = list(pieces.usable())
        lowest = min(s for _, _, s in usable)
        self.unknown = lowest - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for text, i, score in usable:
            self.automaton.add_word(text, (len(text), i, score))
        self.automaton.make_automaton()
        self.single = {t for t, _, _ in usable if len(t) == 1}
        self.whole = any(re.search(f"[^{SPACE}]{SPACE}", t) for t, _, _ in usable)

    def viterbi(self, text: str) -> tuple[list[int], float]:
        """Identifiers of the best segmentation of an escaped text, and its score."""
        n = len(text)
        best = [0.0] + [-float("inf")] * n
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        lone = [i for i, c in enumerate(text) if c not in self.single]
        alone = set(lone)
        last = 0
        matches = self.automaton.iter(text)
        for end, (size, piece, score) in matches:
            end += 1
            if end > last:
                # Characters without a piece of their own up to here can stand for themselves.
                for i in range(last, end):
                    if i in alone and best[i] + self.unknown > best[i + 1]:
                        best[i + 1], back[i + 1] = best[i] + self.unknown, (1, -1)
                last = end
            new = best[end - size] + score
            if new > best[end]:
                best[end], back[end] = new, (size, piece)
            elif new == best[end] and back[end][1] == -1:
                back[end] = (size, piece)
        for i in range(last, n):
            if i in alone and best[i] + self.unknown > best[i + 1]:
                best[i + 1], back[i + 1] = best[i] + self.unknown, (1, -1)
        out: list[int] = []
        at = n
        while at:
            size, piece = back[at]
            if piece < 0:
                sign = SPACE if text[at - 1] == _LITERAL else text[at - 1]
                out += [self.pieces.of_byte[b] for b in reversed(sign.encode())]
            else:
                out.append(piece)
            at -= size
        return out[::-1], best[n]

    def escaped(self, text: str) -> str:
        return (SPACE if self.pieces.prefix and text else "") + text.replace(SPACE, _LITERAL).replace(" ", SPACE)

    def __missing__(self, chunk: str) -> bytes:
        found = np.array(self.viterbi(chunk)[0], np.int32).tobytes()
        if len(chunk) < 100:
            if len(self) >= REMEMBERED:
                self.clear()
            self[chunk] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        signs = self.escaped(text)
        if self.whole:
            chunks = [signs]
        elif SPACE * 2 in signs or not signs.startswith(SPACE) or signs.endswith(SPACE):
            chunks = re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+$", signs)
        else:
            chunks = [SPACE + c for c in signs.split(SPACE)[1:]]
        return np.frombuffer(b"".join(map(self.__getitem__, chunks)), np.int32)

    @cached_property
    def _bytes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and length of each piece's bytes, and the bytes; space signs are spaces."""
        parts = [t.replace(SPACE, " ").encode() for t in self.pieces.text]
        for b, i in enumerate(self.pieces.of_byte):
            parts[i] = bytes([b])
        for i, k in enumerate(self.pieces.kind):
            if k not in (_NORMAL, _USER, _BYTE):
                parts[i] = b""
        size = np.array([len(p) for p in parts])
        return np.cumsum(size) - size, size, np.frombuffer(b"".join(parts), np.uint8)

    @cached_property
    def _gains(self) -> np.ndarray:
        """What each identifier adds to a path's score: a character without a piece adds ``unknown``
        once, with the first of its bytes."""
        out = np.array(self.pieces.score, float)
        for b, i in enumerate(self.pieces.of_byte):
            out[i] = 0.0 if 0x80 <= b < 0xC0 else self.unknown
        return out

    def score(self, ids: np.ndarray) -> float:
        """Score of the path that ``encode`` took: that of its Viterbi passes."""
        return float(self._gains[ids].sum())

    def decode(self, ids: np.ndarray) -> str:
        start, size, data = self._bytes
        n = size[ids]
        total = int(n.sum())
        within = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
        text = data[np.repeat(start[ids], n) + within].tobytes().decode(errors="replace")
        return text.removeprefix(" ") if self.pieces.prefix else text


_workers: dict[str, Coder] = {}


def _coder(key: str, shipped) -> Coder:
    if key not in _workers:
        _workers[key] = Coder(shipped.value)
    return _workers[key]


def _forget() -> None:
    """Let go of the chunks met, so that a worker doesn't hold them during other stages."""
    for coder in _workers.values():
        coder.clear()


def _ship(df: DataFrame, model_path: str):
    """The pieces, whose number does not depend on the data, for all workers."""
    return df.sparkSession.sparkContext.broadcast(Pieces(model_path))


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_pieces, pieces)`` for each row: identifiers of the best segmentation, in order.

    Null and empty texts have no pieces; null ids and repeated rows pass through; other columns are
    not read; an empty table gives an empty result.  Ties go to the longer last piece.
    """
    shipped, key = _ship(docs, model_path), model_path

    def step(batch: pa.RecordBatch) -> dict:
        coder = _coder(key, shipped)
        found = [coder.encode(t or "") for t in batch.column(1).to_pylist()]
        n = np.array([len(f) for f in found], np.int64)
        cuts = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
        return {id_col: batch.column(0), "n_pieces": pa.array(n), "pieces": pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(found) if found else np.empty(0, np.int32))).cast(pa.list_(pa.field("element", pa.int32())))}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs.select(id_col, text_col), text_col, f"`{id_col}` {kind}, n_pieces long, pieces array<int>", step, SMALL_BYTES, done=_forget)


def decode(rows: DataFrame, model_path: str, id_col: str = "doc_id", pieces_col: str = "pieces") -> DataFrame:
    """``(id, text)`` for each row of identifiers; null is decoded as empty."""
    shipped, key = _ship(rows, model_path), model_path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(key, shipped)
        for batch in batches:
            texts = [coder.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, pieces_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_pieces, score, pieces_sha256, decoded_sha256, exact)`` for each row: number of
    pieces, score of the best path, digests of their identifiers (4-byte little-endian) and of the decoded text, and
    whether that is the text.  Cases as in ``encode``."""
    shipped, key = _ship(docs, model_path), model_path

    def step(batch: pa.RecordBatch) -> dict:
        coder = _coder(key, shipped)
        out: dict[str, list] = {"n_pieces": [], "score": [], "pieces_sha256": [], "decoded_sha256": [], "exact": []}
        for text in batch.column(1).to_pylist():
            ids = coder.encode(text or "")
            back = coder.decode(ids)
            out["n_pieces"].append(len(ids))
            out["score"].append(coder.score(ids))
            out["pieces_sha256"].append(hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(back.encode()).hexdigest())
            out["exact"].append(back == (text or ""))
        return out | {id_col: batch.column(0)}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs.select(id_col, text_col), text_col, f"`{id_col}` {kind}, n_pieces long, score double, pieces_sha256 string, decoded_sha256 string, exact boolean", step, done=_forget)
