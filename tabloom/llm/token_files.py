"""Token ids in binary shard files with a keyed index.

A shard is two files. ``<name>.ids`` holds the raw ids of its documents one
after another, little-endian, 2 bytes each where the vocabulary allows, else
4. ``<name>.idx`` holds a JSON header (its length first, 8 bytes), the offsets
of all documents, and the keyed index: a minimal perfect hash over the
document keys, and by its slots a stored 32-bit fingerprint and the document's
place. A key that was never stored fails its fingerprint, but for a chance of
2**-32, and then the stored key itself. The manifest has the least and the
greatest key of each shard, so a key leads to its shard; there the perfect
hash, a few bits a key, is read once, and each access reads one entry of each
table and the ids by their offsets.

Attempts write under names of their own and report them only when complete;
the manifest lists the files that count. A task that is run again after an
executor was lost leaves at most a file that no manifest names.
"""

from __future__ import annotations

import bisect
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import n_parts, new_dir, range_bounds, range_of
from .perfect_hash import PerfectHash, fingerprints
from .tokens import encode_column, vocabulary_size

_COLUMNS = ("shard", "name", "docs", "ids", "low", "high")
_MANIFEST = "shard long, name string, docs long, ids long, low long, high long"
_PARTS = ("keys", "known", "offsets", "marks", "places", "hash")


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class ShardWriter:
    """One shard: documents in the order given. Memory: 24 bytes a document, whatever their lengths."""

    def __init__(self, uri: str, name: str, width: int):
        self.store, self.path = _store(uri)
        self.name, self.width = name, width
        self.keys: list[int | None] = []
        self.counts: list[int] = []
        self.out = self.store.open_output_stream(f"{self.path}/{name}.ids")

    def add(self, key: int | None, ids: bytes) -> None:
        """*ids* have the shard's width already."""
        self.out.write(ids)
        self.keys.append(key)
        self.counts.append(len(ids) // self.width)

    def close(self, shard: int) -> pa.RecordBatch:
        """Write the index; gives the manifest's row. A key that repeats is found at its first document; null keys are only in the order of the file."""
        self.out.close()
        known = np.array([k is not None for k in self.keys], dtype=bool)
        keys = np.array([k or 0 for k in self.keys], dtype="<i8")
        place = np.flatnonzero(known)
        distinct, first = np.unique(keys[place], return_index=True)
        place = place[first].astype("<i8")
        mph = PerfectHash.build(distinct.view("<u8"))
        slot = mph.slots(distinct.view("<u8"))
        marks, places = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<i8")
        marks[slot], places[slot] = fingerprints(distinct.view("<u8")), place
        offsets = np.concatenate([[0], np.cumsum(self.counts)]).astype("<i8")
        table = mph.to_bytes()
        parts = [keys.tobytes(), np.packbits(known).tobytes(), offsets.tobytes(), marks.tobytes(), places.tobytes(), table]
        head = json.dumps({"width": self.width, "docs": len(keys), "keys": len(distinct), "parts": [len(p) for p in parts]}).encode()
        with self.store.open_output_stream(f"{self.path}/{self.name}.idx") as f:
            f.write(len(head).to_bytes(8, "little") + head)
            for p in parts:
                f.write(p)
        keyed = [k for k in self.keys if k is not None]
        row = (shard, self.name, len(self.keys), sum(self.counts), keyed[0] if keyed else None, keyed[-1] if keyed else None)
        kinds = [pa.string() if name == "name" else pa.int64() for name in _COLUMNS]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=list(_COLUMNS))


class ShardReader:
    """Documents of a shard by key, in constant time, or by place.

    Opening reads the header and the perfect hash; the tables by document are
    read entry by entry, or whole the first time that many are asked for.
    """

    def __init__(self, uri: str, name: str):
        self.store, path = _store(uri)
        self.index = self.store.open_input_file(f"{path}/{name}.idx")
        n = int.from_bytes(self.index.read_at(8, 0), "little")
        self.head = json.loads(self.index.read_at(n, 8))
        begins = np.concatenate([[8 + n], 8 + n + np.cumsum(self.head["parts"])])
        self.part = {p: (int(begins[i]), int(self.head["parts"][i])) for i, p in enumerate(_PARTS)}
        self.mph = PerfectHash.from_bytes(self._bytes("hash"))
        self.ids = self.store.open_input_file(f"{path}/{name}.ids")
        self.whole: dict[str, np.ndarray] = {}

    def _bytes(self, part: str) -> bytes:
        begin, size = self.part[part]
        return self.index.read_at(size, begin)

    def _table(self, part: str, kind: str) -> np.ndarray:
        if part not in self.whole:
            self.whole[part] = np.frombuffer(self._bytes(part), kind)
        return self.whole[part]

    def _entries(self, part: str, kind: str, at: int, n: int = 1) -> np.ndarray:
        """Entries at .. at + n of a table, without the rest of it."""
        size = np.dtype(kind).itemsize
        return np.frombuffer(self.index.read_at(n * size, self.part[part][0] + at * size), kind)

    @property
    def keys(self) -> np.ndarray:
        return self._table("keys", "<i8")

    @property
    def known(self) -> np.ndarray:
        return np.unpackbits(self._table("known", "u1"), count=self.head["docs"]).astype(bool)

    @property
    def offsets(self) -> np.ndarray:
        return self._table("offsets", "<i8")

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of many *keys*; -1 for a key that is not stored."""
        keys = np.asarray(keys, dtype="<i8")
        slot = self.mph.slots(keys.view("<u8"))
        out = np.full(len(keys), -1, dtype=np.int64)
        hit = np.flatnonzero(slot >= 0)
        hit = hit[self._table("marks", "<u4")[slot[hit]] == fingerprints(keys[hit].view("<u8"))]
        place = self._table("places", "<i8")[slot[hit]]
        same = self.keys[place] == keys[hit]
        out[hit[same]] = place[same]
        return out

    def _read(self, begin: int, end: int) -> bytes:
        width = self.head["width"]
        return self.ids.read_at((end - begin) * width, begin * width)

    def at(self, begin: int, end: int) -> np.ndarray:
        """The ids begin .. end of the shard, read from the file."""
        return np.frombuffer(self._read(begin, end), f"<u{self.head['width']}").astype("<u4")

    def get(self, key: int) -> np.ndarray:
        """The ids of one document: four entries of the index and one stretch of ids are read. KeyError if it is not here."""
        asked = np.array([key], dtype="<i8").view("<u8")
        slot = int(self.mph.slots(asked)[0])
        if slot < 0 or self._entries("marks", "<u4", slot)[0] != fingerprints(asked)[0]:
            raise KeyError(key)
        place = int(self._entries("places", "<i8", slot)[0])
        if self._entries("keys", "<i8", place)[0] != key:
            raise KeyError(key)
        begin, end = self._entries("offsets", "<i8", place, 2)
        return self.at(int(begin), int(end))


def shard_of(manifest: list[dict], key: int) -> dict:
    """The shard that holds the first document of *key*, by the ranges of keys; KeyError if none can."""
    keyed = [m for m in manifest if m["high"] is not None]
    k = bisect.bisect_left([m["high"] for m in keyed], key)
    if k == len(keyed) or keyed[k]["low"] > key:
        raise KeyError(key)
    return keyed[k]


def lookup(uri: str, manifest: list[dict], key: int) -> np.ndarray:
    """The ids of the first document of *key*."""
    return ShardReader(uri, shard_of(manifest, key)["name"]).get(key)


def write_shards(docs: DataFrame, path: str, uri: str | None = None, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, list[dict]]:
    """Encode whole texts and write them in ascending *id_col* order (nulls first); gives the folder and the manifest.

    A null text is empty, so that only *end* is stored. Rows that repeat an id
    are all stored, in the order of their texts' hashes. The manifest has a row
    for each shard, so its size is bounded by the number of shards. Texts are
    encoded where they lie; only ids are dealt into ranges.
    """
    spark = docs.sparkSession
    uri = uri or new_dir(spark, "tokens")
    store, root = _store(uri)
    store.create_dir(root, recursive=True)
    width = 2 if max(vocabulary_size(path), end + 1) <= 1 << 16 else 4

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, rows in encode_column(path, batch.column(3), end):
                if width == 2:
                    rows = [np.frombuffer(r, "<u4").astype("<u2").tobytes() for r in rows]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, b - a) for c in range(3)], pa.array(rows, pa.binary())], names=["shard", "key", "hash", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, out = None, None
        for batch in batches:
            for number, key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if out is not None and number != shard:
                    yield out.close(shard)
                    out = None
                if out is None:
                    shard, out = number, ShardWriter(uri, f"{number:06d}-{uuid.uuid4().hex}", width)
                out.add(key, ids)
        if out is not None:
            yield out.close(shard)

    narrow = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text")).withColumn("hash", F.xxhash64("text"))
    n = n_parts(spark)
    bounds = range_bounds(narrow.select("key", "hash"), n)
    shard = range_of(F.struct(F.col("key").alias("a"), F.col("hash").alias("b")), bounds, "struct<a:bigint,b:bigint>")
    encoded = narrow.select(shard.cast("long").alias("shard"), "key", "hash", "text").mapInArrow(encode, "shard long, key long, hash long, ids binary")
    # The ranges are fixed before, so that no sampling encodes texts twice, and nothing but ids is moved.
    dealt = encoded.repartition(n, "shard").sortWithinPartitions("shard", "key", "hash", "ids")
    manifest = [r.asDict() for r in dealt.mapInArrow(write, _MANIFEST).collect()]
    return uri, sorted(manifest, key=lambda m: m["shard"])


def read_shards(spark, uri: str, manifest: list[dict], id_col: str = "doc_id") -> DataFrame:
    """Per document: its id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit bytes).

    The first document of each key is found by it through the index, which must
    know it (KeyError); those that repeat a key, or have none, are read by place.
    """
    total, rows = 0, []
    for m in manifest:
        rows.append((m["name"], total))
        total += m["ids"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = ShardReader(uri, row["name"])
                places = np.arange(len(shard.keys))
                keyed = np.flatnonzero(shard.known)
                distinct, first = np.unique(shard.keys[keyed], return_index=True)
                found = shard.find(distinct)
                if (found < 0).any():
                    raise KeyError(f"{row['name']}: the index does not know {int(distinct[found < 0][0])}")
                places[keyed[first]] = found
                offsets, known, keys = shard.offsets, shard.known, shard.keys
                begin = 0
                while begin < len(places):
                    end = int(np.searchsorted(offsets, offsets[begin] + 2_000_000, "right")) - 1
                    end = min(max(end, begin + 1), len(places))
                    some = places[begin:end]
                    starts, ends = offsets[some], offsets[some + 1]
                    if (some[1:] == some[:-1] + 1).all():  # in a row, as written: read at once
                        flat = shard.at(int(starts[0]), int(ends[-1]))
                        cuts = (starts - starts[0]).tolist() + [int(ends[-1] - starts[0])]
                        ids = [flat[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
                    else:
                        ids = [shard.at(int(a), int(b)).tobytes() for a, b in zip(starts, ends, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(keys[begin:end], mask=~known[begin:end]),
                            pa.array(row["base"] + starts),
                            pa.array(ends - starts),
                            pa.array(ids, pa.binary()),
                        ],
                        names=[id_col, "start", "n_tokens", "ids"],
                    )
                    begin = end

    schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    files = spark.createDataFrame(rows, "name string, base long")
    return files.repartition(max(1, len(rows))).mapInArrow(read, schema)


def stored_digests(docs: DataFrame, path: str, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards, read them back, and give id, start, n_tokens, ids_crc32 for each document."""
    uri, manifest = write_shards(docs, path, end=end, id_col=id_col, text_col=text_col)
    back = read_shards(docs.sparkSession, uri, manifest, id_col)
    return back.select(id_col, "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

