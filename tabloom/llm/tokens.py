"""Cutting texts into chunks that a byte-level BPE encodes one by one.

The split pattern of these vocabularies never matches across a single space
between two characters that are no white space: the space always begins the
next match. Nor across a single line feed between two such characters, which
is a match of its own. So the ids of a text are those of its chunks in a row,
and most chunks are words that have been seen before.

A batch of texts is one run of UTF-8 bytes. The places to cut at are found in
it by array operations, its chunks are numbered by Arrow's dictionary encoding,
and what a document gives is a slice of what its chunks give in a row; so the
interpreter only touches chunks that are new to a worker.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa

#: Chunks kept per worker and generation, and the bytes of the longest that is kept: bounds of memory, not of input.
KEPT, LONGEST = 300_000, 64
#: Bytes of texts that are worked on at once; a longer text is a batch of its own.
BATCH = 8_000_000
MARKS = (".", ",", ";", ":", "!", "?")
#: The split pattern that the cuts above hold for.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ASCII_SPACE = np.zeros(256, dtype=bool)
_ASCII_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


def _wide_space(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whether the UTF-8 bytes a, b, c are a white-space character of three bytes, or b, c one of two."""
    two = (b == 0xC2) & ((c == 0x85) | (c == 0xA0))
    general = (a == 0xE2) & (b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    return two | general | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE2) & (b == 0x81) & (c == 0x9F)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))


def _space_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends just before *at* (1 or more) is white space."""
    last = data[at - 1]
    out = _ASCII_SPACE[last]
    high = np.flatnonzero(last >= 0x80)
    if len(high):
        k = at[high]
        out[high] = _wide_space(data[np.maximum(k - 3, 0)], data[np.maximum(k - 2, 0)], last[high])
    return out


def _space_after(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that begins at *at* is white space."""
    first = data[at]
    out = _ASCII_SPACE[first]
    high = np.flatnonzero(first >= 0xC2)
    if len(high):
        a, end = at[high], len(data) - 1
        b, c = data[np.minimum(a + 1, end)], data[np.minimum(a + 2, end)]
        out[high] = _wide_space(first[high], b, c) | ((first[high] == 0xC2) & ((b == 0x85) | (b == 0xA0)))
    return out


def cut_offsets(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks begin and end in *data*, and for each text the number of the chunk that it begins with (and one more for the end).

    *ends* are the offsets of the texts, first 0, last the length. An empty text has no chunk.
    """
    if not len(data):
        return np.zeros(1, np.int64), np.zeros(len(ends), np.int64)
    sep = np.flatnonzero((data == 0x20) | (data == 0x0A))
    sep = sep[(sep > 0) & (sep < len(data) - 1)]
    sep = sep[~(_space_before(data, sep) | _space_after(data, sep + 1))]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[ends] = True
    # A separator that ends or begins a text is no lone one.
    sep = sep[~(cut[sep] | cut[sep + 1])]
    cut[sep] = True
    cut[sep[data[sep] == 0x0A] + 1] = True
    offsets = np.flatnonzero(cut)
    return offsets, np.searchsorted(offsets, ends)


class Chunked:
    """For a batch of texts, what their chunks give as bytes, by functions of a chunk.

    *encode* gives for a chunk, as text, a byte string for each of the
    *results*, as a tuple, or itself where there is one; a document's result is
    its chunks' joined. What chunks gave is remembered in two generations: when
    the newer one is full it becomes the older, and that is forgotten, but for
    what has been seen again meanwhile.
    """

    def __init__(self, encode: Callable[[str], tuple[bytes, ...] | bytes], results: int, kept: int | None = None):
        self.encode, self.results, self.kept = encode, results, kept
        self.known: dict[bytes, object] = {}
        self.before: dict[bytes, object] = {}

    def _new(self, chunk: bytes):
        got = self.before.get(chunk)
        if got is None:
            got = self.encode(chunk.decode())
        if len(chunk) <= LONGEST:
            if len(self.known) >= (self.kept or KEPT):
                self.before, self.known = self.known, {}
            self.known[chunk] = got
        return got

    def _all(self, chunks: list[bytes]) -> list:
        get, new = self.known.get, self._new
        out = list(map(get, chunks))
        for i in [i for i, g in enumerate(out) if g is None]:
            out[i] = new(chunks[i])
        return out

    def batch(self, texts: list[str | None]) -> list[list[memoryview]]:
        """For each result the bytes of each text (null: empty)."""
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        ends = np.zeros(len(raw) + 1, dtype=np.int64)
        np.cumsum([len(r) for r in raw], out=ends[1:])
        return self.joined(b"".join(raw), ends)

    def joined(self, data: bytes, ends: np.ndarray) -> list[list[memoryview]]:
        """The same for texts that lie in a row."""
        offsets, first = cut_offsets(np.frombuffer(data, np.uint8), ends)
        chunks = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
        coded = chunks.dictionary_encode()
        given = self._all(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        out = []
        for k in range(self.results):
            row = pa.array(given if self.results == 1 else [g[k] for g in given], pa.large_binary()).take(coded.indices)
            at = np.frombuffer(row.buffers()[1], np.int64, len(row) + 1, row.offset * 8) if len(row) else np.zeros(1, np.int64)
            whole = memoryview(row.buffers()[2]) if len(row) and row.buffers()[2] is not None else memoryview(b"")
            place = at[first].tolist()
            out.append([whole[a:b] for a, b in zip(place, place[1:], strict=False)])
        return out

    def column(self, texts: pa.Array, limit: int = BATCH):
        """Batches of a text column: (first row, end row, for each result the bytes of each of these rows)."""
        texts = texts.cast(pa.large_string())
        if texts.null_count:
            texts = texts.fill_null("")
        n = len(texts)
        if not n:
            return
        ends = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
        data = texts.buffers()[2]
        begin = 0
        while begin < n:
            end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + limit, "right")) - 1)
            end = min(end, n)
            low, high = int(ends[begin]), int(ends[end])
            piece = data.slice(low, high - low).to_pybytes() if data is not None else b""
            yield begin, end, self.joined(piece, ends[begin : end + 1] - low)
            begin = end


_ENCODERS: dict[tuple, Chunked] = {}


def _letters() -> dict[int, str]:
    """How the tokenizers library writes bytes as characters: visible ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def vocabulary_size(path: str) -> int:
    """One more than the greatest id of a tokenizers file; it must split texts by the byte-level pattern, or else this is an error."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    split = made.get("pre_tokenizer") or {}
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or made.get("normalizer") or made["model"].get("type") != "BPE":
        raise ValueError(f"{path}: only byte-level BPE with its own split pattern, no prefix space and no normaliser can be cut into chunks")
    return 1 + max([*made["model"]["vocab"].values(), *[t["id"] for t in made.get("added_tokens", [])]])


def byte_bpe(path: str, kept: int | None = None) -> Chunked:
    """Ids of a tokenizers file as little-endian unsigned 32-bit bytes.

    The strings of special tokens in a text are ordinary text. A chunk without
    control characters is split here and its pieces are given to the library's
    BPE model one by one, which saves the bookkeeping of a whole encoding; any
    other chunk is encoded by the library as a text.
    """
    key = ("tokenizers", path, kept)
    if key not in _ENCODERS:
        vocabulary_size(path)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        split = regex.compile(PATTERN).findall
        letters, tokenize = _letters(), tokenizer.model.tokenize
        known: dict[str, bytes] = {}

        def piece_ids(piece: str) -> bytes:
            # Latin-1 gives a character for each byte, which translate() then writes as the library does.
            if not piece.isascii():
                piece = piece.encode().decode("latin-1")
            return array("I", [t.id for t in tokenize(piece.translate(letters))]).tobytes()

        def of_piece(piece: str) -> bytes:
            ids = known.get(piece)
            if ids is None:
                ids = piece_ids(piece)
                if len(piece) <= LONGEST:
                    if len(known) >= (kept or KEPT):
                        known.clear()
                    known[piece] = ids
            return ids

        def encode(text: str) -> bytes:
            word = text[1:] if text[:1] == " " else text
            if word.isalpha():  # one piece, and most chunks are such; the caller remembers it
                return piece_ids(text)
            if word[-1:] in MARKS and word[:-1].isalpha():
                return of_piece(text[:-1]) + of_piece(word[-1])
            if text.isprintable():
                return b"".join(map(of_piece, split(text)))
            return array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

        _ENCODERS[key] = Chunked(encode, 1, kept)
    return _ENCODERS[key]


def encode_texts(path: str, texts: list[str | None], end: int | None = None) -> list[bytes]:
    """Ids of whole texts (null: empty) as little-endian unsigned 32-bit bytes, with *end* appended."""
    tail = b"" if end is None else np.array([end], dtype="<u4").tobytes()
    return [bytes(p) + tail for p in byte_bpe(path).batch(texts)[0]]


def encode_column(path: str, texts: pa.Array, end: int, limit: int = BATCH, kept: int | None = None):
    """Batches of a text column: (first row, end row, ids of each of these rows with *end* appended)."""
    tail = np.array([end], dtype="<u4").tobytes()
    for a, b, (ids,) in byte_bpe(path, kept).column(texts, limit):
        yield a, b, [bytes(p) + tail for p in ids]
