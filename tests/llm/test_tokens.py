"""Tokens, token files, byte-level BPE and packing against the libraries and by brute force."""

import base64
import hashlib
import json
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabloom.llm import bpe, common, packing, perfect_hash, queries, token_files, tokens

BYTE, MULTI = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
LETTERS = "ab  \n\t 1é世'sTHe.,!\x1c\x85 　-_😀\r<|endoftext|>٣ǅ́"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(BYTE)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


def fuzz(n=3000):
    rng = random.Random(5)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 40))) for _ in range(n)] + ["<|endoftext|> a", "I'm you're it's", "x" * 3000]


def test_chunks_give_the_librarys_ids(library):
    texts = fuzz()
    for text, ids in zip(texts, tokens.encode_texts(BYTE, texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library(text), repr(text)


def test_small_caches(library, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 20)
    monkeypatch.setattr(tokens, "_ENCODERS", {})
    texts = fuzz(300)
    for text, ids in zip(texts, tokens.encode_texts(BYTE, texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library(text)


def test_bpe_is_tiktokens(tik):
    own, texts = bpe.load(MULTI, P.PATTERN), fuzz()
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids == tik[0].encode_ordinary(text)
        assert own.decode(ids) == text.encode()


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=1, max_size=60))
def test_merge_is_leftmost_least(piece):
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 300, b"ba": 299, b"aba": 301, b"\x00\x00": 302, b"\x00\x00\x00": 303}
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not found:
            break
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    assert bpe.merge(piece, ranks) == [ranks[p] for p in parts]


def test_long_piece_takes_little_time(tik):
    word = "ab" * 100_000
    assert bpe.load(MULTI, P.PATTERN).encode([word])[0] == tik[0].encode_ordinary(word)


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 5000)).view(np.uint64)
    mph = perfect_hash.PerfectHash.from_bytes(perfect_hash.PerfectHash.build(keys).to_bytes())
    assert sorted(mph.slots(keys).tolist()) == list(range(len(keys)))
    assert perfect_hash.PerfectHash.build(keys[:0]).n == 0


def brute_files(rows, library):
    """Rows that repeat an id in the order of Spark's hash of their texts, which is its seed for a null."""
    out, start = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, np.uint64(42 if r[1] is None else xxhash.xxh64_intdigest(r[1], 42)).astype(np.int64))):
        ids = np.array([*library(text), 0], "<u4")
        out.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_files(spark, odd, none, library):
    got = token_files.stored_digests(odd, BYTE).collect()
    want = brute_files([(r.doc_id, r.text) for r in odd.collect()], library)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_files.stored_digests(none, BYTE).count() == 0


def test_keyed_access(spark, odd, library):
    uri, manifest = token_files.write_shards(odd, BYTE)
    texts = {r.doc_id: r.text for r in odd.collect()}
    seen = {}
    for m in manifest:
        shard = token_files.ShardReader(uri, m["name"])
        for key in [k for k in texts if k is not None]:
            try:
                seen[key] = shard.get(key).tolist()
            except KeyError:
                pass
        with pytest.raises(KeyError):
            shard.get(12345)
        assert (shard.find(np.arange(1000, 9000)) == -1).all()
    assert seen == {k: [*library(t), 0] for k, t in texts.items() if k is not None}


def test_lookup_across_shards(spark, library):
    rows = [(k * 3, f"text {k}") for k in range(200)] + [(30, "again"), (None, "no key")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    uri, manifest = token_files.write_shards(docs, BYTE)
    assert len(manifest) > 1
    for k in (0, 3, 300, 597):
        assert token_files.lookup(uri, manifest, k).tolist() == [*library(f"text {k // 3}"), 0]
    assert token_files.lookup(uri, manifest, 30).tolist() in ([*library("text 10"), 0], [*library("again"), 0])
    for k in (-1, 1, 598, 10**12):
        with pytest.raises(KeyError):
            token_files.lookup(uri, manifest, k)


def test_other_split_patterns_are_refused():
    with pytest.raises(ValueError):
        tokens.byte_bpe(P.path("word_bpe_49k.json"))
    with pytest.raises(ValueError):
        bpe.RankBPE(MULTI, r"\w+|\W+")


@pytest.mark.parametrize("part", ["marks", "places"])
def test_rows_are_read_through_the_index(spark, odd, part):
    """An index that has lost its keys is an error, whether its fingerprints or its places are wrong."""
    uri, manifest = token_files.write_shards(odd, BYTE)
    store, root = token_files._store(uri)
    for m in manifest:
        with store.open_input_file(f"{root}/{m['name']}.idx") as f:
            data = bytearray(f.read())
        n = int.from_bytes(data[:8], "little")
        sizes = json.loads(data[8 : 8 + n])["parts"]
        k = {"marks": 3, "places": 4}[part]
        at = 8 + n + sum(sizes[:k])
        whole = np.frombuffer(bytes(data[at : at + sizes[k]]), "<u4" if part == "marks" else "<i8")
        data[at : at + sizes[k]] = (whole ^ 1 if part == "marks" else whole * 0).astype(whole.dtype).tobytes()
        with store.open_output_stream(f"{root}/{m['name']}.idx") as f:
            f.write(bytes(data))
    with pytest.raises(Exception, match="the index does not know"):
        token_files.read_shards(spark, uri, manifest).collect()


def test_query_files(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, queries.op3_token_files(spark, sf).collect())) == brute_files([tuple(r) for r in docs], library)


def test_query_bpe(spark, sf, tik):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op5_byte_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = tik[0].encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_bpe_of_odd_rows(spark, odd, none, tik):
    rows = bpe.round_trip_digests(odd, MULTI, P.PATTERN).collect()
    want = [hashlib.sha256((r.text or "").encode()).hexdigest() for r in odd.collect()]
    assert [r.decoded_sha256 for r in rows] == want
    encoded = bpe.encode_documents(odd, MULTI, P.PATTERN)
    assert [bytes(r.decoded).decode() for r in bpe.decode_documents(encoded, MULTI, P.PATTERN).collect()] == [r.text or "" for r in odd.collect()]
    assert bpe.round_trip_digests(none, MULTI, P.PATTERN).count() == 0


def held(rows, docs, library, most):
    """The pieces are the documents, and the sequences have no gaps and no overlaps; gives their number."""
    by, sequences = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= most
    want = {}
    for key, text in docs:
        ids = np.array([*library(text), 2], "<u4")
        cuts = packing.cut_points(len(ids), most)
        assert all(n == most for _, n in cuts[1:])
        want.setdefault(key, []).extend((k, a, n, zlib.crc32(ids[a : a + n].tobytes())) for k, (a, n) in enumerate(cuts))
    assert {k: sorted((r.piece, r.start, r.length, r.ids_crc32) for r in v) for k, v in by.items()} == {k: sorted(v) for k, v in want.items()}
    return len(sequences)


def test_packing(spark, sf, odd, none, library):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = queries.op8_best_fit_packing(spark, sf).collect()
    n = held(rows, docs, library, 1024)
    assert n <= 1.02 * sum(r.length for r in rows) / 1024 + 1
    held(packing.pack_documents(odd, BYTE, most=64).collect(), [(r.doc_id, r.text) for r in odd.collect()], library, 64)
    assert packing.pack_documents(none, BYTE).count() == 0


def taken(gaps, pieces):
    """One round by a stack: each piece, longest first, takes the last gap that holds it. Gives what is matched, and the gaps and pieces that stay."""
    gaps, pieces = sorted(gaps, reverse=True), sorted(pieces, reverse=True)
    matched, stack, stay, i = [], [], [], 0
    for p in pieces:
        while i < len(gaps) and gaps[i] >= p:
            stack.append(gaps[i])
            i += 1
        if stack:
            matched.append((stack.pop(), p))
        else:
            stay.append(p)
    return matched, stack + gaps[i:], stay


def in_rounds(lengths, most):
    """The number of sequences that rounds over plain lists give."""
    n, gaps, cuts = sum(x == most for x in lengths), [], [most, *(most // b for b in packing.BANDS), 0]
    for high, low in zip(cuts, cuts[1:], strict=False):
        band = [x for x in lengths if low < x <= high and x < most]
        while band:
            matched, free, band = taken(gaps, band)
            gaps = [g for g in [*free, *(a - b for a, b in matched)] if g]
            k = packing.opened(Counter(band), Counter(gaps), most, bool(matched))
            n, gaps, band = n + k, gaps + [most - x for x in band[:k]], band[k:]
    return n


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=60), st.lists(st.integers(1, 12), max_size=60), st.lists(st.integers(0, 120), max_size=6))
def test_sweeps_of_tasks_meet_as_one_sweep(gaps, pieces, bounds):
    rows = sorted([(-g, 0, i) for i, g in enumerate(gaps)] + [(-p, 1, i) for i, p in enumerate(pieces)])
    at = sorted({0, len(rows), *(min(b, len(rows)) for b in bounds)})
    found, left, over = [], [], []
    for task, (a, b) in enumerate(zip(at, at[1:], strict=False)):
        part = rows[a:b]
        x, y = packing.sweep(np.array([r[1] == packing.GAP for r in part]))
        found += [(part[i], part[j]) for i, j in zip(x, y, strict=True)]
        rest = [r for i, r in enumerate(part) if i not in {*x, *y}]
        kinds = [[r for r in rest if r[1] == k] for k in (0, 1)]
        assert rest == kinds[1] + kinds[0]
        left.append((task, *map(len, kinds)))
        over += [(task, k, i, r) for k in (0, 1) for i, r in enumerate(kinds[k])]
    spans = packing.meet(left)
    assert len(spans) <= 4 * len(left)
    pairs, stay = {}, {}
    for task, kind, i, r in over:
        *_, base, sign = max(s for s in spans if s[:2] == (task, kind) and s[2] <= i)
        if sign:
            pairs.setdefault(base + sign * i, [None, None])[kind] = r
        elif kind == packing.PIECE:
            stay[base + i] = r
    found += pairs.values()
    matched, _, waiting = taken(gaps, pieces)
    assert sorted((-g[0], -p[0]) for g, p in found) == sorted(matched)
    assert [-stay[k][0] for k in range(len(stay))] == waiting


def test_encoding_holds_little_at_once(spark):
    """The memory that a worker is left with hangs neither on an earlier stage's arrays nor on how large a batch is; and no row is lost at the slices' borders."""
    texts = ["a b c " * 1000, None, "", "d"] * 400
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    resident = lambda: int(next(x for x in open("/proc/self/status") if x.startswith("VmRSS")).split()[1])
    kept = np.ones(1, dtype=np.int8)
    lots = [bytes(1000) for _ in range(300_000)]
    lots, kept = kept, [lots[-1]]  # freed, but for the last: the heap can't shrink from its end
    before = resident()
    common.give_back()
    assert len(kept) == 1 and resident() < before - 200_000
    got = packing.pieces(docs, BYTE, 2, 1024).select("__key", "piece", "length").collect()
    want = {k: n for k, n in enumerate(len(x) // 4 for x in tokens.encode_texts(BYTE, texts, 2))}
    by = Counter()
    for r in got:
        by[r["__key"]] += r["length"]
    assert by == want and len({(r["__key"], r["piece"]) for r in got}) == len(got)


def test_many_short_pieces_take_few_jobs(spark):
    """Rounds of what one task holds are no Spark jobs."""
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 != 0, F.concat(F.lit("a "), F.col("id").cast("string"))).otherwise("b").alias("text"))
    context = spark.sparkContext
    context.setJobGroup("few", "few")
    got = packing.pack_documents(docs, BYTE, most=64).collect()
    context.setLocalProperty("spark.jobGroup.id", None)
    assert len(context.statusTracker().getJobIdsForGroup("few")) <= 12
    lengths = [r.length for r in got]
    assert len(lengths) == 600 and len({r.sequence_id for r in got}) == in_rounds(lengths, 64)


def test_rounds_hold_for_more_tasks_than_asked(spark, sf, monkeypatch):
    """What a sweep gives must not hang on how many tasks it was dealt to."""
    items = spark.range(400).select(F.when(F.col("id") < 150, packing.GAP).otherwise(packing.PIECE).alias("kind"), (F.col("id") * 7 % 50 + 1).alias("size"), "id")
    deal = type(items).repartitionByRange
    monkeypatch.setattr(type(items), "repartitionByRange", lambda self, n, *by: deal(self, 9, *by))
    after, _ = packing._round(items, 1)
    sizes = {k: [r["size"] for r in items.collect() if r["kind"] == k] for k in (packing.GAP, packing.PIECE)}
    matched, _, waiting = taken(sizes[packing.GAP], sizes[packing.PIECE])
    rows = after.collect()
    assert sorted((r["size"], r["length"]) for r in rows if r["kind"] == packing.MATCH) == sorted(matched)
    assert [r["size"] for r in sorted((r for r in rows if r["kind"] == packing.PIECE), key=lambda r: r["rank"])] == waiting


@pytest.mark.parametrize("rows", [40, 100_000])
def test_rounds_give_what_lists_give(spark, sf, rows):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(300)
    got = packing.pack_documents(docs, BYTE, rows=rows).collect()
    lengths = [r.length for r in got]
    n = len({r.sequence_id for r in got})
    assert n == in_rounds(lengths, 1024) <= 1.02 * sum(lengths) / 1024 + 1


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 30), max_size=12))
def test_rounds_are_as_good_as_best_fit(histogram):
    lengths = sorted((k for k, v in histogram.items() for _ in range(v)), reverse=True)
    gaps = []
    for length in lengths:
        fit = [g for g in gaps if g >= length]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - length)
        else:
            gaps.append(32 - length)
    assert in_rounds(lengths, 32) <= len(gaps) * 1.25 + 1
