"""Best-fit packing of documents into sequences of a fixed length.

Bulk-synchronous best-fit. In each round the open gaps and the open pieces are
range-sorted together, longest first, a gap before the pieces that fill it. One
sweep then gives each piece its successor, the smallest gap not yet taken that
holds it: every task sweeps its own range, and what its pieces or gaps have
over is told apart by rank, so that runs of gaps meet runs of pieces of later
ranges. Each gap takes one piece at most in a round; the gaps are updated, and
the next round begins. Pieces that no gap holds open sequences, longest first:
as many as their length needs beyond the room of the gaps that are left.

Lengths are dealt with in bands (above a half of *most*, a quarter, a
sixteenth, the rest), so that short pieces fill what the long ones leave. The
number of rounds grows with the pieces of a sequence, not with the rows. As
soon as the open gaps and pieces are no more than one task sweeps, the rounds
that are left are that task's: they need no shuffle, so it goes on by itself.
The driver holds counts by length (at most ``most``) and by task, and no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, n_parts, new_dir
from .tokens import encode_column

#: Kinds of rows of a round.
GAP, PIECE, MATCH = 0, 1, 2
#: Rows (20 bytes each) of a task of a sweep, unless that makes more tasks than the session has shuffle partitions; so many or fewer go on in one task.
ROWS = 400_000
#: A band ends above these shares of the sequence length.
BANDS = (2, 4, 16)
#: Bytes of texts that are encoded at once: the workers of a pipeline hold models of other stages beside.
BATCH = 2_000_000
#: Rows of a batch whose texts are copied at once.
SLICE = 500


def cut_points(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: the first may be shorter, all others have *most*."""
    first = n % most or most
    return [(0, min(first, n))] + [(a, most) for a in range(first, n, most)]


def sweep(opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the gaps (true in *opens*) and of the pieces that take them; each piece takes the last gap before it that is free."""
    depth = np.cumsum(np.where(opens, 1, -1))
    # Gaps and pieces that go up to or down from the same level alternate, and neighbours belong together.
    level = np.where(opens, depth, depth + 1)
    order = np.argsort(level, kind="stable")
    a, b = order[:-1], order[1:]
    pair = (level[a] == level[b]) & opens[a] & ~opens[b]
    return a[pair], b[pair]


def meet(left: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Spans of what the tasks' sweeps have left over, at most four a task.

    *left* gives (task, gaps, pieces); a task's pieces stand before its gaps. A
    span (task, kind, first, base, sign) holds from its first rank on: with a
    sign, base + sign * rank numbers the match; without, base + rank numbers
    the pieces, or the gaps, that stay.
    """
    spans, stack, matched, stay = [], [], 0, 0
    for task, gaps, pieces in sorted(left):
        at = 0
        while at < pieces and stack:
            top = stack[-1]
            m = min(top[1], pieces - at)
            spans.append((top[0], GAP, top[1] - m, matched + top[1] - 1, -1))
            spans.append((task, PIECE, at, matched - at, 1))
            matched, at, top[1] = matched + m, at + m, top[1] - m
            if not top[1]:
                stack.pop()
        if at < pieces:
            spans.append((task, PIECE, at, stay - at, 0))
            stay += pieces - at
        if gaps:
            stack.append([task, gaps])
    return spans + [(task, GAP, 0, 0, 0) for task, _ in stack]


def opened(waiting: dict[int, int], gaps: dict[int, int], most: int, matched: bool) -> int:
    """How many of the pieces that no gap holds open a sequence; pieces and gaps as counts by size."""
    if not waiting:
        return 0
    room = sum(size * n for size, n in gaps.items() if size >= min(waiting))
    need = -(-(sum(size * n for size, n in waiting.items()) - room) // most)
    alone = sum(n for size, n in waiting.items() if 2 * size > most)
    return min(max(need, alone, 0 if matched else 1), sum(waiting.values()))


def finish(kind: np.ndarray, size: np.ndarray, key: np.ndarray, bands: list[tuple[int, int]], most: int) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """All rounds of *bands*, (low, high) each, over gaps and pieces that one task holds: (piece, sequence, offset) of all pieces, and (size, id) of the gaps that stay."""
    order = np.argsort(key, kind="stable")  # the same result in whatever order rows come
    kind, size, key = kind[order], size[order], key[order]
    pieces, gaps, placed = (size[kind == PIECE], key[kind == PIECE]), (size[kind == GAP], key[kind == GAP]), []
    joined = lambda *parts: tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    counts = lambda x: {k: n for k, n in enumerate(np.bincount(x).tolist()) if n}
    small = np.min_scalar_type(2 * most + 1)
    for low, high in bands:
        of = (pieces[0] > low) & (pieces[0] <= high)
        waiting, fits = tuple(x[of] for x in pieces), gaps[0] > low
        wait, gaps = [tuple(x[~fits] for x in gaps)], tuple(x[fits] for x in gaps)
        while len(waiting[0]):
            size, key = joined(gaps, waiting)
            opens = np.arange(len(size)) < len(gaps[0])
            order = np.argsort((2 * (most - size) + ~opens).astype(small), kind="stable")
            size, key, opens = size[order], key[order], opens[order]
            a, b = sweep(opens)
            placed.append((key[b], key[a], most - size[a]))
            alone = np.ones(len(opens), dtype=bool)
            alone[a] = alone[b] = False
            gaps = joined((size[a] - size[b], key[a]), (size[alone & opens], key[alone & opens]))
            waiting = size[alone & ~opens], key[alone & ~opens]
            n = opened(counts(waiting[0]), counts(gaps[0]), most, len(a) > 0)
            placed.append((waiting[1][:n], waiting[1][:n], np.zeros(n, dtype=np.int64)))
            gaps = joined(gaps, (most - waiting[0][:n], waiting[1][:n]))
            waiting = tuple(x[n:] for x in waiting)
            fits = gaps[0] > low
            # Gaps that hold no piece of this band wait for the next.
            wait.append(tuple(x[~fits & (gaps[0] > 0)] for x in gaps))
            gaps = tuple(x[fits] for x in gaps)
        gaps = joined(*wait, gaps)
    return joined(*placed) if placed else (np.zeros(0, dtype=np.int64),) * 3, gaps


def _from(at: int, encoded: Iterator[tuple[int, int, list[bytes]]]) -> Iterator[tuple[int, int, list[bytes]]]:
    """What a slice that begins at row *at* gives, with the rows of the whole."""
    return ((at + a, at + b, texts) for a, b, texts in encoded)


def pieces(docs: DataFrame, path: str, end: int, most: int, id_col: str = "doc_id", text_col: str = "text", kept: int | None = None) -> DataFrame:
    """Per piece: its document's id, piece, start, length, ids_crc32, and a number of its own."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        # What an earlier stage's tasks have left in a reused worker.
        give_back()
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for a, b, texts in (x for at in range(0, len(keys), SLICE) for x in _from(at, encode_column(path, batch.column(1).slice(at, SLICE), end, BATCH, kept))):
                rows = []
                for key, ids in zip(keys[a:b], texts, strict=True):
                    for k, (start, length) in enumerate(cut_points(len(ids) // 4, most)):
                        rows.append((key, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), uid))
                        uid += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (batch.schema.field(0).type, pa.int32(), *[pa.int64()] * 4), strict=True)], names=[f.name for f in schema])
            give_back()

    schema = T.StructType(
        [T.StructField("__key", docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType())]
        + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "__uid")]
    )
    return docs.select(F.col(id_col).alias("__key"), F.col(text_col).cast("string").alias("text")).mapInArrow(encode, schema)


def _written(df: DataFrame, kind: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder."""
    path = new_dir(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _swept(items: DataFrame, n: int) -> DataFrame:
    """The rows of one round, (kind, size, id, mate, length, task, rank): each task's matches, and what it has left over with its rank.

    The ranks of the pieces left over are 0-based by task, longest first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy() for c in batch.columns] for batch in batches]
        if not parts:
            return
        kind, size, key = (np.concatenate(x) for x in zip(*parts, strict=True))
        opens = kind == GAP
        a, b = sweep(opens)
        alone = np.ones(len(opens), dtype=bool)
        alone[a] = alone[b] = False
        kind = np.where(opens, GAP, PIECE)[alone]
        rank = np.where(kind == GAP, np.cumsum(kind == GAP), np.cumsum(kind == PIECE)) - 1
        none, task = np.zeros(len(kind), dtype=np.int64), TaskContext.get().partitionId()
        found = (
            np.concatenate([np.full(len(a), MATCH), kind]).astype(np.int32),
            *(np.concatenate(x) for x in ((size[a], size[alone]), (key[a], key[alone]), (key[b], none), (size[b], none))),
            np.full(len(a) + len(kind), task),
            np.concatenate([np.zeros(len(a), dtype=np.int64), rank]),
        )
        yield from pa.table([pa.array(x) for x in found], names=["kind", "size", "id", "mate", "length", "task", "rank"]).to_batches(1 << 16)

    order = (F.col("size").desc(), F.col("kind"), F.col("id"))
    return _written(items.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(run, "kind int, size long, id long, mate long, length long, task long, rank long"), "sweep")


def _finished(items: DataFrame, bands: list[tuple[int, int]], most: int) -> DataFrame:
    """`finish` in one task, for no more rows than a task of a sweep holds: (kind, id, mate, size), MATCH rows with sequence, piece and offset, GAP rows with id and room."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy() for c in batch.columns] for batch in batches]
        if not parts:
            return
        (piece, sequence, offset), (room, gap) = finish(*(np.concatenate(x) for x in zip(*parts, strict=True)), bands, most)
        kind = np.repeat(np.array([MATCH, GAP], dtype=np.int32), [len(piece), len(gap)])
        found = kind, np.concatenate([sequence, gap]), np.concatenate([piece, gap]), np.concatenate([offset, room])
        yield from pa.table([pa.array(x) for x in found], names=["kind", "id", "mate", "size"]).to_batches(1 << 16)

    return _written(items.repartition(1).mapInArrow(run, "kind int, id long, mate long, size long"), "rest")


def _met(spark: SparkSession, found: DataFrame, spans: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """The rows of a sweep with ``match``, the number of the match across tasks or -1, and ``rank``, of pieces that stay among all that do."""
    # At most four spans a task.
    ordered = sorted(spans)
    table = spark.sparkContext.broadcast((np.array([((t * 2 + k) << 40) + first for t, k, first, _, _ in ordered], dtype=np.int64), *(np.array([x[i] for x in ordered], dtype=np.int64) for i in (3, 4))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, base, sign = table.value
        for batch in batches:
            kind, size, key, mate, length, task, rank = (c.to_numpy() for c in batch.columns)
            if len(first) and len(kind):
                at = np.searchsorted(first, ((task * 2 + kind) << 40) + rank, "right") - 1
                left, paired = kind != MATCH, sign[at] != 0
                match = np.where(left & paired, base[at] + sign[at] * rank, -1)
                rank = np.where(left & ~paired, base[at] + rank, -1)
            else:
                match = np.full(len(kind), -1)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (kind, size, key, mate, length, match, rank)], names=["kind", "size", "id", "mate", "length", "match", "rank"])

    return found.mapInArrow(run, "kind int, size long, id long, mate long, length long, match long, rank long")


def _round(items: DataFrame, n: int) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """One sweep over all tasks: gaps and pieces that stay (these ranked, longest first) and matches, with the room that gaps have; their counts by kind and room."""
    after = _swept(items, n)
    left: dict[int, list[int]] = {}
    # Two rows a task at most.
    for r in after.where(F.col("kind") != MATCH).groupBy("task", "kind").count().collect():
        left.setdefault(r["task"], [0, 0])[r["kind"]] = r["count"]
    met = _met(items.sparkSession, after, meet([(task, *x) for task, x in left.items()]))
    side = {"size": (GAP, "size"), "id": (GAP, "id"), "mate": (PIECE, "id"), "length": (PIECE, "size")}
    # Two rows a match.
    crossed = met.where("match >= 0").groupBy("match").agg(*[F.max(F.when(F.col("kind") == k, F.col(x))).alias(c) for c, (k, x) in side.items()])
    columns = ("kind", *side, "rank")
    after = _written(met.where("match < 0").select(*columns).union(crossed.select(F.lit(MATCH).alias("kind"), *side, F.lit(-1).cast("long").alias("rank"))), "round")
    after = after.withColumn("room", F.when(F.col("kind") == MATCH, F.col("size") - F.col("length")).otherwise(F.col("size")))
    # No more sizes of a kind than the sequence length.
    return after, {(r["kind"], r["room"]): r["count"] for r in after.groupBy("kind", "room").count().collect()}


def _placed(done: DataFrame) -> DataFrame:
    return done.where(F.col("kind") == MATCH).select(F.col("mate").alias("__uid"), F.col("id").alias("sequence_id"), F.col("size").alias("offset"))


def place(small: DataFrame, sizes: dict[int, int], most: int, rows: int = ROWS) -> list[DataFrame]:
    """Where the pieces (size, id) of *small* go, all shorter than *most*, as tables (__uid, sequence_id, offset); *sizes* counts them by size.

    A sequence has the number of the piece that opens it.
    """
    placed: list[DataFrame] = []
    gaps: list[DataFrame] = []
    n_gaps: dict[int, int] = {}
    is_match, is_piece = F.col("kind") == MATCH, F.col("kind") == PIECE
    parts = n_parts(small.sparkSession)
    in_one = lambda n: n <= rows or parts == 1
    ends = [most, *(most // b for b in BANDS), 0]
    bands = list(zip(ends[1:], ends, strict=False))
    for k, (low, high) in enumerate(bands):
        n_pieces = sum(n for size, n in sizes.items() if low < size <= high)
        if not n_pieces:
            continue
        all_left = in_one(sum(n for size, n in sizes.items() if size <= high) + sum(n_gaps.values()))
        floor = 0 if all_left else low
        items = small.where((F.col("size") > floor) & (F.col("size") <= high)).select(F.lit(PIECE).alias("kind"), "size", "id")
        for g in gaps:
            items = items.union(g.where(F.col("size") > floor))
        if all_left:
            placed.append(_placed(_finished(items, bands[k:], most)))
            break
        gaps = [g.where(F.col("size") <= low) for g in gaps]
        while n_pieces:
            n = n_pieces + sum(n for size, n in n_gaps.items() if size > low)
            if in_one(n):
                done = _finished(items, [(low, high)], most)
                placed.append(_placed(done))
                gaps.append(done.where(F.col("kind") == GAP).select("kind", "size", "id"))
                n_gaps = {size: n for size, n in n_gaps.items() if size <= low}
                # One row for each size.
                for r in gaps[-1].groupBy("size").count().collect():
                    n_gaps[r["size"]] = n_gaps.get(r["size"], 0) + r["count"]
                break
            after, counts = _round(items, min(-(-n // rows), parts))
            n_gaps = {size: n for size, n in n_gaps.items() if size <= low}
            for (kind, room), n in counts.items():
                if kind != PIECE and room:
                    n_gaps[room] = n_gaps.get(room, 0) + n
            waiting = {room: n for (kind, room), n in counts.items() if kind == PIECE}
            n_open = opened(waiting, n_gaps, most, any(kind == MATCH for kind, _ in counts))
            n_pieces, rest = sum(waiting.values()) - n_open, n_open
            for size in sorted(waiting, reverse=True):
                take = min(rest, waiting[size])
                if take:
                    n_gaps[most - size] = n_gaps.get(most - size, 0) + take
                rest -= take
            opens = is_piece & (F.col("rank") < n_open)
            placed.append(
                after.where(is_match | opens).select(
                    F.when(is_match, F.col("mate")).otherwise(F.col("id")).alias("__uid"),
                    F.col("id").alias("sequence_id"),
                    F.when(is_match, most - F.col("size")).otherwise(F.lit(0)).cast("long").alias("offset"),
                )
            )
            rows_left = after.select(
                F.when(is_piece & ~opens, PIECE).otherwise(GAP).alias("kind"),
                F.when(opens, most - F.col("size")).otherwise(F.col("room")).alias("size"),
                "id",
            )
            items = rows_left.where(is_piece | (F.col("size") > low))
            # Gaps that hold no piece of this band wait for the next.
            gaps.append(rows_left.where(~is_piece & (F.col("size") > 0) & (F.col("size") <= low)))
        else:
            # The last round's other gaps wait as well.
            gaps.append(items)
    return placed


def pack_documents(docs: DataFrame, path: str, end: int = 2, most: int = 1024, id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS, kept: int | None = None) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty, so its document is one piece of the *end* id. Only
    documents of more than *most* ids are cut. Rows that repeat an id are
    packed each; an empty table gives no pieces. A sequence has the number of
    the piece that opens it. *rows* is what one task of a sweep holds; with
    no more of them open, the rounds go on in one task. *kept* is how many
    chunks of texts a worker remembers in each of two generations.
    """
    made = _written(pieces(docs, path, end, most, id_col, text_col, kept), "pieces")
    # One row for each length, so no more than `most`.
    sizes = {r["length"]: r["count"] for r in made.where(F.col("length") < most).groupBy("length").count().collect()}
    full = made.where(F.col("length") == most).withColumn("sequence_id", F.col("__uid")).withColumn("offset", F.lit(0).cast("long"))
    placed = place(made.where(F.col("length") < most).select(F.col("length").alias("size"), F.col("__uid").alias("id")), sizes, most, rows)
    out = full.drop("__uid")
    if placed:
        out = out.union(made.where(F.col("length") < most).join(reduce(DataFrame.union, placed), "__uid").drop("__uid"))
    return out.withColumnRenamed("__key", id_col)
