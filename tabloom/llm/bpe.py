"""Byte-level BPE by ranks: encoding with a segment tree over byte positions, and decoding.

The tree's leaves are byte positions; the leaf of a live token holds the rank
of the pair it makes with its live right neighbour, and inner nodes, of FAN
children each, the least (rank, position), so the least of the top is the
leftmost pair of least rank. A merge changes the leaves of the merged token,
its right and its left neighbour: each is one walk to the top. A piece of n
bytes takes O(n log n) steps, long unbroken ones included; most pieces are
short and have one level.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import KEPT, LONGEST, PATTERN, Chunked


FAN = 16
_NONE = 1 << 62


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the leftmost pair of least rank is merged until no pair has a rank."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    end = list(range(1, n + 1))  # of the live token that begins here
    left = list(range(-1, n - 1))  # where the live token before begins
    get = ranks.get
    leaves = [_NONE] * n
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            leaves[i] = r * n + i
    levels = [leaves]
    while len(levels[-1]) > FAN:
        below = levels[-1]
        levels.append([min(below[k : k + FAN]) for k in range(0, len(below), FAN)])
    top = levels[-1]

    while (low := min(top)) < _NONE:
        i = low % n
        j = end[i]
        stop = end[i] = end[j]
        before = left[i]
        leaves[j] = leaves[i] = _NONE
        if stop < n:
            left[stop] = i
            r = get(piece[i : end[stop]])
            if r is not None:
                leaves[i] = r * n + i
        if before >= 0:
            r = get(piece[before:stop])
            leaves[before] = _NONE if r is None else r * n + before
        if top is leaves:
            continue
        for at in (j, i, before):
            if at < 0:
                continue
            k, below = at, leaves
            for level in levels[1:]:
                k //= FAN
                least = min(below[k * FAN : k * FAN + FAN])
                if level[k] == least:
                    break
                level[k], below = least, level
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class RankBPE:
    """A vocabulary of ranks with its split pattern.

    A chunk gives three results: its ids as bytes, its ids in decimal each
    followed by a comma, and the bytes decoded from its ids.
    """

    def __init__(self, path: str, pattern: str):
        import regex

        if pattern != PATTERN:
            raise ValueError("texts can only be cut into chunks for the byte-level split pattern")
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.find = regex.compile(pattern).findall
        self.table = {v: k for k, v in self.ranks.items()}
        self.known: dict[str, tuple[int, ...]] = {}
        self.chunked = Chunked(self._encode, 3)

    def _piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one match of the pattern; a whole match with a rank is one token, as the library has it."""
        data = piece.encode()
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        ids = self.known.get(piece)
        if ids is None:
            ids = tuple(merge(data, self.ranks))
            if len(piece) <= LONGEST:
                if len(self.known) >= KEPT:
                    self.known.clear()
                self.known[piece] = ids
        return ids

    def _encode(self, text: str) -> tuple[bytes, bytes, bytes]:
        word = text[1:] if text[:1] == " " else text
        # Most chunks are one match.
        ids = self._piece(text) if word.isalpha() else list(chain.from_iterable(map(self._piece, self.find(text))))
        return array("I", ids).tobytes(), "".join([f"{i}," for i in ids]).encode(), self.decode(ids)

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of whole texts; a null text has none."""
        return [np.frombuffer(p, "<u4").tolist() for p in self.chunked.batch(texts)[0]]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))


_LOADED: dict[tuple[str, str], RankBPE] = {}


def load(path: str, pattern: str) -> RankBPE:
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = RankBPE(path, pattern)
    return _LOADED[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id and ``ids``, an array of the ids of its whole text (null or empty text: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            for a, b, (ids, _, _) in bpe.chunked.column(batch.column(1)):
                ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), flat)], names=[id_col, "ids"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.select(id_col, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: its id and ``decoded``, the bytes of its ids (null ids: null; an unknown id is an error)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            out = [None if ids is None else bpe.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[id_col, "decoded"])

    schema = T.StructType([T.StructField(id_col, encoded.schema[id_col].dataType), T.StructField("decoded", T.BinaryType())])
    return encoded.select(id_col, ids_col).mapInArrow(run, schema)


def round_trip_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, n_tokens, ids_sha256 of the decimal ids joined by commas, decoded_sha256 of the bytes decoded from them.

    A null or empty text gives no ids and the digests of nothing. Encoding and
    decoding share one pass, so that ids do not travel between them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sha = load(path, pattern), hashlib.sha256
        for batch in batches:
            for a, b, (ids, lines, decoded) in bpe.chunked.column(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([sha(x[:-1]).hexdigest() for x in lines]),  # without the last comma
                        pa.array([sha(x).hexdigest() for x in decoded]),
                    ],
                    names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    schema = T.StructType(
        [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType())] + [T.StructField(c, T.StringType()) for c in ("ids_sha256", "decoded_sha256")]
    )
    return docs.select(id_col, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)
