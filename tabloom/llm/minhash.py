"""Near-duplicates by fast similarity sketching, banding and exact verification.

A document's set is that of its distinct shingles, as 64-bit hashes. Its
sketch has SIZE coordinates and is filled in rounds: in round i < SIZE each
element falls into a hashed bin with a value in [i, i + 1), in round
SIZE + i into bin i; a bin keeps its least value, and the rounds end with the
first that leaves no bin empty, after 2 * SIZE at the latest. Coordinates of
two sketches agree with the sets' similarity as probability, concentrated as
if they were independent, at a cost near the set's size.

Equal sets form one class, whose least document stands for it. Bands of ROWS
coordinates put classes into buckets; 1 - (1 - 0.85 ** 5) ** 26 of the links
at the threshold share one, all but 3 in 10 million. Not all pairs of a bucket
are formed. First, each class is compared in full sets with one pivot, the
first class of the buckets that it shares most; hot groups of copies become
one component so, with one comparison a copy. Then, in buckets that still
hold several components, every class outside the bucket's largest one looks
for the closest class of another component, by bitmaps that bound the
similarity from above, and only that pair is compared. What is linked is drawn
together, and last, all pairs that are still in different components and that
the bitmaps cannot rule out are compared. So any pair that shares a bucket is
in one component, is proved unlinked by the exact bound, or was compared.

Large buckets are dealt into blocks, so that no task holds one whole. Sets and
texts are moved only for classes that share a bucket: a sieve (a bitmap of
fixed size) keeps the others where they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, cut_narrow, n_parts, passes, sieve, sifted
from .components import components
from .perfect_hash import mix

SHINGLE = 5
ROWS, BANDS = 5, 26
SIZE = ROWS * BANDS
#: Parities kept of each set.
BITS = 1024
#: Rows of a block of a bucket: of those that look for partners, and of those that are looked at.
LEFT, RIGHT = 512, 2048
#: Pairs whose bitmaps are compared at once: a bound of memory.
AT_ONCE = 100_000
#: Pairs that one copy of a pivot's set serves in the join that verifies them.
PER_COPY = 200

_U = np.uint64
_COEFFICIENTS = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted; fewer words than a shingle are one; no words: none.

    bytes.lower() lower-cases A-Z only, and bytes.split() splits at 0x20 and 0x09-0x0D.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    k = min(SHINGLE, len(words))
    n = len(words) - k + 1
    with np.errstate(over="ignore"):
        out = np.full(n, k, dtype=np.uint64)
        for i in range(k):
            out += mix(h[i : i + n], i) * _COEFFICIENTS[i]
    return np.unique(mix(out, 99))


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Fast similarity sketches of non-empty sets, one row each."""
    out = np.full((len(sets), SIZE), np.iinfo(np.uint64).max, dtype=np.uint64)
    flat = out.reshape(-1)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    elements = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    base = np.repeat(np.arange(len(sets)) * SIZE, sizes)
    for i in range(2 * SIZE):
        if not len(elements):
            break
        h = mix(elements, 1000 + i)
        bins = (h % _U(SIZE)).astype(np.int64) if i < SIZE else i - SIZE
        np.minimum.at(flat, base + bins, (_U(i) << _U(54)) | (h >> _U(10)))
        empty = (out == np.iinfo(np.uint64).max).any(axis=1)
        keep = empty[base // SIZE]
        elements, base = elements[keep], base[keep]
    return out


def band_hashes(sketch: np.ndarray) -> np.ndarray:
    """(documents, BANDS): a hash of each band."""
    out = np.zeros((len(sketch), BANDS), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(ROWS):
            out = mix(out ^ sketch[:, j::ROWS][:, :BANDS], j) + _U(j)
    return mix(out + np.arange(BANDS, dtype=np.uint64)[None, :], 7)


def bitmap(s: np.ndarray) -> bytes:
    """BITS parities of the set's elements, packed.

    Two bitmaps differ in no more bits than their sets differ in elements, so
    |a and b| <= (|a| + |b| - differing bits) / 2: a bound that is exact.
    """
    odd = np.bincount((s >> _U(20)).astype(np.int64) % BITS, minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def digest(s: np.ndarray) -> bytes:
    """The class of a set."""
    return xxhash.xxh3_128_digest(s.tobytes())


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: key, n_shingles, class (128-bit hash of the set; null if it is empty), bands, bits, text_hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a in range(0, len(texts), 500):
                sets = [shingle_set(t) for t in texts[a : a + 500]]
                some = [i for i, s in enumerate(sets) if len(s)]
                bands: list = [None] * len(sets)
                # A block of elements at a time, so that a run of long texts stays small.
                at = 0
                while at < len(some):
                    end, held = at, 0
                    while end < len(some) and (end == at or held + len(sets[some[end]]) <= 500_000):
                        held += len(sets[some[end]])
                        end += 1
                    for i, row in zip(some[at:end], band_hashes(sketches([sets[j] for j in some[at:end]])).view(np.int64), strict=True):
                        bands[i] = row
                    at = end
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([digest(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array(bands, pa.list_(pa.int64())),
                        pa.array([bitmap(s) if len(s) else None for s in sets], pa.binary()),
                        batch.column(2).slice(a, len(sets)),
                    ],
                    names=["key", "n_shingles", "class", "bands", "bits", "text_hash"],
                )

    schema = T.StructType(
        [
            T.StructField("key", docs.schema[id_col].dataType),
            T.StructField("n_shingles", T.LongType()),
            T.StructField("class", T.BinaryType()),
            T.StructField("bands", T.ArrayType(T.LongType())),
            T.StructField("bits", T.BinaryType()),
            T.StructField("text_hash", T.LongType()),
        ]
    )
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("key"), text.alias("text"), F.xxhash64(text).alias("text_hash")).mapInArrow(run, schema)


def _sets(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(cid, set) of the *classes*, from the text of the document that stands for each."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(sieve(classes.select("source")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(sifted(held.value, batch.column(0).to_numpy())))
            for a in range(0, len(some), 200):
                sets = [s for s in map(shingle_set, some.column(1).slice(a, 200).to_pylist()) if len(s)]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["class", "set"])

    text = F.col(text_col).cast("string")
    made = docs.select(_source(F.col(id_col), F.xxhash64(text)).alias("source"), text.alias("text")).mapInArrow(run, "class binary, set array<bigint>")
    return made.dropDuplicates(["class"]).join(classes.select("class", "cid"), "class").select("cid", "set")


def _source(key: Column, text_hash: Column) -> Column:
    """A hash of a document's id and text."""
    return F.xxhash64(key, text_hash)


def _sized(a: Column, b: Column, percent: int) -> Column:
    """Whether sets of these sizes can reach the threshold at all."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold. A hot *a* is split: its set is copied once for PER_COPY pairs."""
    copies = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PER_COPY).cast("int").alias("copies"))
    left = copies.join(sets.select(F.col("cid").alias("a"), F.col("set").alias("a_set")), "a")
    left = left.select("a", "a_set", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    dealt = pairs.join(copies, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int").alias("copy"))
    right = dealt.join(sets.select(F.col("cid").alias("b"), F.col("set").alias("b_set")), "b")
    both = F.size(F.array_intersect("a_set", "b_set"))
    whole = F.size("a_set") + F.size("b_set") - both
    return right.join(left, ["a", "copy"]).where(100 * both >= percent * whole).select("a", "b")


def _candidates(percent: int, closest: bool):
    """What compares the rows of each block: all left with all right ones, by sizes, components and bitmaps."""

    def compare(rows: dict[str, np.ndarray], at: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, cid, comp, bits = rows["n"], rows["cid"], rows["comp"], rows["bits"]
        a, b = n[at], n[to]
        open_ = (comp[at] != comp[to]) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
        if not closest:  # of two that both look for partners, one does
            open_ &= rows["main"][to] | (cid[at] < cid[to])
        at, to = at[open_], to[open_]
        differ = np.bitwise_count(bits[at] ^ bits[to]).sum(axis=1, dtype=np.int64)
        both = n[at] + n[to]
        may = (100 + percent) * (both - differ) >= 2 * percent * both
        at, to, away = at[may], to[may], differ[may] / both[may]
        if closest and len(at):
            order = np.lexsort((to, away, at))
            order = order[np.concatenate([[True], at[order][1:] != at[order][:-1]])]
            at, to = at[order], to[order]
        return cid[at], cid[to]

    def block(rows: dict[str, np.ndarray]):
        """Pairs of whole groups, a bounded number of them at once, but never less than all partners of a row."""
        group, right = rows["group"], rows["right"]
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        ends = np.append(starts[1:], len(group))
        inside = np.cumsum(np.concatenate([[0], ~right]))
        middle = starts + inside[ends] - inside[starts]
        at = np.flatnonzero(~right)
        of = np.searchsorted(starts, at, "right") - 1
        low, count = middle[of], (ends - middle)[of]
        upto = np.cumsum(count)
        begin = 0
        while begin < len(at):
            done = int(upto[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(upto, done + AT_ONCE, "right")))
            k = count[begin:end]
            first = np.concatenate([[0], np.cumsum(k)[:-1]])
            to = np.arange(int(k.sum())) - np.repeat(first, k) + np.repeat(low[begin:end], k)
            yield compare(rows, np.repeat(at[begin:end], k), to)
            begin = end

    def columns(batch: pa.Table) -> dict[str, np.ndarray]:
        out = {c: batch.column(c).to_numpy() for c in ("bucket", "lb", "rb", "cid", "n", "comp")}
        out |= {c: batch.column(c).to_numpy().astype(bool) for c in ("right", "main")}
        raw = b"".join(batch.column("bits").to_pylist())
        return out | {"bits": np.frombuffer(raw, np.uint64).reshape(-1, BITS // 64)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def give(rows: pa.Table):
            of = columns(rows)
            change = np.zeros(len(rows), dtype=bool)
            for c in ("bucket", "lb", "rb"):
                change[1:] |= of[c][1:] != of[c][:-1]
            of["group"] = np.cumsum(change)
            for a, b in block(of):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            # The last block may go on in the next batch.
            last = [rows.column(c).to_numpy() for c in ("bucket", "lb", "rb")]
            same = np.logical_and.reduce([x == x[-1] for x in last]) if len(rows) else np.zeros(0, bool)
            whole = int(np.flatnonzero(same)[0]) if len(rows) else 0
            if whole:
                yield from give(rows.slice(0, whole).combine_chunks())
            held = rows.slice(whole)
        if held is not None and len(held):
            yield from give(held.combine_chunks())

    return run


def _open_pairs(now: DataFrame, classes: DataFrame, percent: int, closest: bool) -> DataFrame:
    """Pairs (a < b) of different components that share a bucket and may be linked: all, or for each class the closest.

    *now* has (bucket, cid, comp). Classes outside a bucket's largest component
    look for partners, so that a large component is never compared with itself;
    a bucket is dealt into blocks, and each row goes to the blocks of its side.
    """
    spark = now.sparkSession
    sizes = now.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("size"))
    stats = sizes.groupBy("bucket").agg(F.sum("size").alias("all"), F.max(F.struct("size", "comp")).alias("m"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    stats = stats.select(
        *(F.col("bucket").alias("in"), F.col("m.comp").alias("main_comp")),
        F.ceil((F.col("all") - F.col("m.size")) / LEFT).cast("int").alias("lefts"),
        F.ceil(F.col("all") / RIGHT).cast("int").alias("rights"),
    )
    open_ = now.join(stats, F.col("bucket") == F.col("in")).drop("in")
    full = open_.join(classes.select(F.col("cid").alias("of"), "n", "bits"), F.col("cid") == F.col("of")).drop("of").withColumn("main", F.col("comp") == F.col("main_comp"))
    dealt = F.xxhash64("cid")
    own = (F.pmod(dealt, F.col("lefts")).cast("int"), F.pmod(dealt, F.col("rights")).cast("int"))
    looked = F.transform(F.sequence(F.lit(0), F.col("lefts") - 1), lambda k: F.struct(k.alias("lb"), own[1].alias("rb"), F.lit(1).alias("right")))
    looking = F.transform(F.sequence(F.lit(0), F.col("rights") - 1), lambda k: F.struct(own[0].alias("lb"), k.alias("rb"), F.lit(0).alias("right")))
    places = F.explode(F.when(F.col("main"), looked).otherwise(F.concat(looked, looking))).alias("x")
    rows = full.select("bucket", "cid", "n", "comp", F.col("main").cast("int").alias("main"), "bits", places)
    rows = rows.select("bucket", "x.lb", "x.rb", "x.right", "cid", "n", "comp", "main", "bits")
    sorted_ = rows.repartition(n_parts(spark), "bucket", "lb", "rb").sortWithinPartitions("bucket", "lb", "rb", "right")
    return sorted_.mapInArrow(_candidates(percent, closest), "a long, b long").distinct()


def class_components(sets: DataFrame, members: DataFrame, classes: DataFrame, percent: int) -> DataFrame | None:
    """(vertex, component) of the classes that are linked with others; component is the least class of each. None if there is no link.

    *members* has (bucket, cid, n, pivot, pivot_n), *classes* at least (cid, n, bits) of the same.
    """

    def relabelled(labels: DataFrame) -> DataFrame:
        named = narrow.join(labels.withColumnRenamed("vertex", "of"), F.col("cid") == F.col("of"), "left")
        return cut_narrow(named.select("bucket", "cid", F.coalesce("component", "cid").alias("comp")))

    narrow = members.select("bucket", "cid")
    votes = members.where((F.col("cid") != F.col("pivot")) & _sized(F.col("n"), F.col("pivot_n"), percent))
    pairs = cut_narrow(votes.groupBy(F.col("cid").alias("b")).agg(F.mode("pivot", True).alias("a")).select("a", "b"))
    tested = pairs
    links = cut_narrow(_verify(pairs, sets, percent))
    # Pivots may have pivots themselves: two steps up are enough here, as what is not drawn together now is so later.
    up = links.select(F.col("b").alias("vertex"), F.col("a").alias("component"))
    higher = up.select(F.col("vertex").alias("w"), F.col("component").alias("above"))
    labels = up.join(higher, F.col("component") == F.col("w"), "left").select("vertex", F.coalesce("above", "component").alias("component"))
    pairs = cut_narrow(_open_pairs(relabelled(labels), classes, percent, closest=True))
    if not pairs.limit(1).count():
        return components(links, "a", "b") if links.limit(1).count() else None
    links, tested = links.unionByName(cut_narrow(_verify(pairs, sets, percent))), tested.unionByName(pairs)
    if not links.limit(1).count():
        labels = links.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
    else:
        labels = cut_narrow(components(links, "a", "b"))
    pairs = cut_narrow(_open_pairs(relabelled(labels), classes, percent, closest=False).join(tested, ["a", "b"], "left_anti"))
    if not pairs.limit(1).count():
        return labels if links.limit(1).count() else None
    more = cut_narrow(_verify(pairs, sets, percent))
    if not more.limit(1).count():
        return labels if links.limit(1).count() else None
    return components(links.unionByName(more), "a", "b")


def _labelled(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """Per row: key, text_hash, n_shingles, component_id."""
    spark = docs.sparkSession
    rows = cut(signatures(docs, id_col, text_col))
    classes = rows.where("class IS NOT NULL").groupBy("class").agg(
        F.min(F.struct("key", "text_hash")).alias("first"),
        F.min("key").alias("least"),
        F.first("n_shingles").alias("n"),
        F.first("bands").alias("bands"),
        F.first("bits").alias("bits"),
    )
    # Numbers of classes are fixed by the checkpoint.
    source = _source(F.col("first.key"), F.col("first.text_hash")).alias("source")
    classes = cut(classes.select(F.monotonically_increasing_id().alias("cid"), "class", "least", "n", "bands", "bits", source))
    banded = classes.select("cid", "n", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min(F.struct("cid", "n")).alias("p"), F.max("cid").alias("high")).where("p.cid < high")
    shared = cut_narrow(shared.select("bucket", F.col("p.cid").alias("pivot"), F.col("p.n").alias("pivot_n")))
    found = None
    if shared.limit(1).count():
        held = spark.sparkContext.broadcast(sieve(shared.select("bucket")))

        def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bands = batch.column(2).flatten().to_numpy()
                k = np.flatnonzero(sifted(held.value, bands))
                of = pa.array(k // BANDS)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(bands[k])], names=["cid", "n", "bucket"])

        some = classes.select("cid", "n", "bands").mapInArrow(sift, "cid long, n long, bucket long")
        members = cut_narrow(some.join(shared, "bucket").select("bucket", "cid", "n", "pivot", "pivot_n"))
        near = sieve(members.select(F.xxhash64("cid").alias("h")))
        # With a few others that the sieve lets pass.
        own = cut_narrow(classes.select("cid", "class", "n", "bits", "source").where(passes(spark, near, F.xxhash64("cid"))))
        found = class_components(cut(_sets(docs, own, id_col, text_col)), members, own, percent)
    if found is None:
        named = classes.select(F.col("class").alias("of"), F.col("least").alias("component"))
    else:
        # Components of classes become those of documents: the least id of the whole.
        of = classes.select("cid", "class", "least").join(found.withColumnRenamed("component", "comp"), F.col("cid") == F.col("vertex"), "left")
        of = cut(of.select("class", "least", "comp"))
        lows = of.where("comp IS NOT NULL").groupBy("comp").agg(F.min("least").alias("low")).withColumnRenamed("comp", "in")
        named = of.where("comp IS NOT NULL").join(lows, F.col("comp") == F.col("in")).select(F.col("class").alias("of"), F.col("low").alias("component"))
        named = named.unionByName(of.where("comp IS NULL").select(F.col("class").alias("of"), F.col("least").alias("component")))
    out = rows.join(named, F.col("class") == F.col("of"), "left")
    component = F.when(F.col("class").isNull(), F.col("key")).otherwise(F.col("component"))
    return out.select("key", "text_hash", "n_shingles", component.alias("component_id"))


def _kept() -> Column:
    return F.coalesce(F.col("key") == F.col("component_id"), F.col("component_id").isNull())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """Per row: its id, n_shingles, component_id, kept.

    Documents are linked if their sets' intersection is at least *percent*
    hundredths of the union; component_id is the least id reachable, kept is
    true for the row with that id. A document without words is linked with
    nothing. Rows that repeat an id are that id's document each. Among null ids
    nothing can be told apart: such a row is linked like any other, has the
    least id of its component, or null, and is kept in that case.
    """
    out = _labelled(docs, id_col, text_col, percent)
    return out.select(F.col("key").alias(id_col), "n_shingles", "component_id", _kept().alias("kept"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """The rows whose document is the first of its group, with their columns; of rows equal in id and text one stays.

    Only documents that go or that repeat are looked up, so the texts of the
    others, but for a few that the sieve lets pass, are not moved.
    """
    spark = docs.sparkSession
    judged = _labelled(docs, id_col, text_col, percent).select(_source(F.col("key"), F.col("text_hash")).alias("h"), "key", "text_hash", _kept().alias("stays"))
    told = judged.groupBy("h", "key", "text_hash").agg(F.bool_or("stays").alias("stays"), F.count(F.lit(1)).alias("rows"))
    told = cut(told.where("NOT stays OR rows > 1"))
    taken = {c.lower() for c in docs.columns}
    name = next(n for n in (f"source_hash{'_' * k}" for k in range(len(taken) + 1)) if n not in taken)
    text = F.col(text_col).cast("string")
    hashed = docs.withColumn(name, _source(F.col(id_col), F.xxhash64(text)))
    asked = passes(spark, sieve(told.select("h")), F.col(name))
    same = (F.col(name) == F.col("told.h")) & F.col(f"docs.{id_col}").eqNullSafe(F.col("told.key")) & (F.xxhash64(F.col(f"docs.{text_col}").cast("string")) == F.col("told.text_hash"))
    maybe = hashed.where(asked)
    unlisted = maybe.alias("docs").join(told.alias("told"), same, "left_anti")
    again = maybe.alias("docs").join(told.where("stays").alias("told"), same, "left_semi").dropDuplicates([name])
    return hashed.where(~asked).unionByName(unlisted).unionByName(again).select(*[f"`{c}`" for c in docs.columns])
