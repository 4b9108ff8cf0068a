"""Round trips, ranges, errors, metadata, catalog and chunks."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom import runtime
from tabloom.errors import ColumnNotFound, RowRangeError, TableError
from tabloom.functions import factors
from tabloom.operators import joins, sets, verbs
from tabloom.plans.table import Table
from tabloom.sources import store
from tabloom.sources.database import Database
from tabloom.streaming.chunks import ChunkStream, append_stream
from tabloom.types import Attribute, Described, describe, description, meaning

KINDS = {
    "int32": ("int", lambda i: None if i % 7 == 3 else i - 50),
    "int64": ("long", lambda i: None if i % 5 == 1 else i * 10**12),
    "double": ("double", lambda i: None if i % 6 == 2 else (float("nan") if i % 11 == 4 else i / 3)),
    "logical": ("boolean", lambda i: [True, False, None][i % 3]),
    "byte": ("byte", lambda i: i % 256 - 128),
    "character": ("string", lambda i: None if i % 4 == 2 else "é\x00ß"[: i % 4] * (i % 9)),
    "block": ("binary", lambda i: None if i % 4 == 2 else bytes([i % 256]) * (i % 9)),
}


@pytest.mark.parametrize("n", [0, 1, 31, 33, 2047, 4097])
@pytest.mark.parametrize("compress", [0, 30, 50, 51, 70, 100])
def test_round_trip(spark, tmp_path, n, compress):
    schema = "i int, " + ", ".join(f"{k} {t}" for k, (t, _) in KINDS.items())
    rows = [(i, *[f(i) for _, f in KINDS.values()]) for i in range(n)]
    df = spark.createDataFrame(rows, schema)
    path = f"file://{tmp_path}/t"
    store.write_table(df, path, compress)
    back = store.read_table(spark, path, in_order=True)
    assert back.schema == df.schema
    assert [repr(tuple(r)) for r in back.collect()] == [repr(r) for r in rows]
    if n > 2:
        tail = store.read_table(spark, path, ["i"], max(1, n - 5), in_order=True)
        assert [r[0] for r in tail.collect()] == list(range(max(1, n - 5) - 1, n))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('stored')}/t"
    store.write_table(spark.range(0, 1000, 1, 5).select(F.col("id"), (F.col("id") * 2).alias("b"), F.lit("x").alias("B")), path, 30, ["id", "B"])
    return path


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(a=st.integers(1, 1000), b=st.one_of(st.just(-1), st.integers(1, 2000)), columns=st.lists(st.sampled_from(["id", "b", "B"]), min_size=1, max_size=4))
def test_range_is_a_slice(spark, stored, a, b, columns):
    if b != -1 and b < a:
        with pytest.raises(RowRangeError, match="Incorrect row range specified."):
            store.read_table(spark, stored, columns, a, b)
        return
    got = store.read_table(spark, stored, columns, a, b, in_order=True)
    assert got.columns == columns
    values = {"id": lambda i: i, "b": lambda i: 2 * i, "B": lambda i: "x"}
    assert [tuple(r) for r in got.collect()] == [tuple(values[c](i) for c in columns) for i in range(1000)[a - 1 : None if b == -1 else b]]


def test_range_skips_row_groups(spark, stored):
    plan = store.read_table(spark, stored, ["id"], 10, 20)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(__row,9)" in plan
    assert "b:" not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_ordinals_hold_for_any_plan(spark, tmp_path, adaptive):
    """Wide ordered rows, aggregates and repartitioned rows: ordinals are 0 .. n-1, ranges are slices, bound columns stay beside their partners."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        n = 60_000
        wide = spark.range(n).select(F.col("id"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 4).alias("wide"))
        mixed = spark.range(3 * n).select((F.col("id") % n).alias("k"), F.col("id").alias("t"))
        plans = {
            "ordered": (wide.orderBy(F.xxhash64("id")), ["id"], "id"),
            "aggregate": (mixed.groupBy("k").agg(F.max("t").alias("t")), None, "k"),
            "dealt": (wide.repartition(7), None, "id"),
        }
        for name, (df, order, key) in plans.items():
            path = f"file://{tmp_path}/{name}{adaptive}"
            store.write_table(df, path, 30, order=order)
            whole = [r[0] for r in store.read_table(spark, path, [key], in_order=True).collect()]
            assert sorted(whole) == list(range(n))
            if order:
                assert whole == list(range(n))
            for a, b in ((1, 1000), (n // 2, n // 2 + 10), (n - 5, -1)):
                got = [r[0] for r in store.read_table(spark, path, [key], a, b, in_order=True).collect()]
                assert got == whole[a - 1 : None if b == -1 else b]
            numbered = store.with_ordinals(df, order=order).agg(F.count_distinct(store.ROW), F.min(store.ROW), F.max(store.ROW)).first()
            assert tuple(numbered) == (n, 0, n - 1)
        ordered = store.read_table(spark, f"file://{tmp_path}/ordered{adaptive}", ["id"], in_order=True)
        beside = joins.bind_columns(ordered, spark.range(n).select((F.col("id") * 2).alias("twice")))
        assert beside.where("twice = 2 * id").count() == n
        path = f"file://{tmp_path}/grown{adaptive}"
        with ChunkStream(spark, path, "w") as s:
            s.rbind(plans["aggregate"][0])
            s.rbind(plans["aggregate"][0])
            assert s.meta_data().n_rows == 2 * n
        assert store.read_table(spark, path, ["k"], n - 10, n + 10).count() == 21
        assert sorted(r[0] for r in store.read_table(spark, path, ["k"], n + 1).collect()) == list(range(n))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_lost_record_of_extents(spark, tmp_path):
    """The record of how many rows each part has can be made again from the rows."""
    path = f"file://{tmp_path}/t"
    store.write_table(spark.range(0, 100, 1, 5), path)
    import shutil

    shutil.rmtree(tmp_path / "t" / "_ordinals")
    assert [r.id for r in store.read_table(spark, path, None, 18, 43, in_order=True).collect()] == list(range(17, 43))


def test_error_order(spark, stored, tmp_path):
    with pytest.raises(TableError):
        store.read_table(spark, f"file://{tmp_path}/none", ["zz"], 0)
    with pytest.raises(ColumnNotFound, match="Column 'ID' not found"):
        store.read_table(spark, stored, ["ID"], 0)
    with pytest.raises(RowRangeError, match="Parameter fromRow should have a positive value."):
        store.read_table(spark, stored, ["id"], 0, -5)
    with pytest.raises(RowRangeError, match="Row selection is out of range."):
        store.read_table(spark, stored, ["id"], 1001, 3)
    with pytest.raises(RowRangeError, match="Incorrect row range specified."):
        store.read_table(spark, stored, ["id"], 10, 9)
    empty = f"file://{tmp_path}/empty"
    store.write_table(spark.range(0), empty)
    assert store.read_table(spark, empty, None, 5, 7).count() == 0
    with pytest.raises(RowRangeError, match="Incorrect row range specified."):
        store.read_table(spark, empty, None, 5, 3)
    (tmp_path / "bad").write_text("not a table")
    with pytest.raises(TableError):
        store.read_table(spark, f"file://{tmp_path}/bad")


def test_meta_and_keys(spark, stored):
    m = store.table_meta(spark, stored)
    assert (m.names, m.types, m.n_rows, m.keys, m.version) == (["id", "b", "B"], ["bigint", "bigint", "string"], 1000, ["id", "B"], 1)
    assert store.key_index(m.keys, ["B", "id"]) == [1, 0]
    assert store.key_index(m.keys, ["B"]) == []
    assert store.key_index(m.keys, ["b", "id"]) == [1]


def test_zero_columns(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    store.write_table(spark.createDataFrame([], T.StructType([])), path)
    assert store.read_table(spark, path).columns == []


def test_foreign_dataset(spark, tmp_path):
    path = f"file://{tmp_path}/plain"
    spark.range(0, 1000, 1, 4).write.parquet(path)
    assert [r[0] for r in store.read_table(spark, path, ["id"], 240, 260, in_order=True).collect()] == list(range(239, 260))


def test_later_version(spark, tmp_path):
    path = f"file://{tmp_path}/later"
    df = spark.range(1).withColumn(store.ROW, F.lit(0).cast("long")).withMetadata(store.ROW, {"tabloom": {"version": 9, "names": ["id"], "keys": []}})
    df.write.parquet(path)
    with pytest.raises(TableError, match="format version 9"):
        store.read_table(spark, path)


def test_damaged_head(spark, tmp_path):
    path = f"file://{tmp_path}/damaged"
    df = spark.range(1).withColumn(store.ROW, F.lit(0).cast("long")).withMetadata(store.ROW, {"tabloom": {"version": 1, "names": ["id", "x"], "keys": [], "hash": "0"}})
    df.write.parquet(path)
    with pytest.raises(TableError, match="damaged"):
        store.table_meta(spark, path)


def test_descriptions(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, 1.5, 100, 3_600, 5), (None, None, None, None, None, None)], "d int, t int, x double, n long, o int, s int")
    df = describe(df, "d", Described(Attribute.INT_32_DATE_DAYS))
    df = describe(df, "t", Described(Attribute.INT_32_TIMESTAMP_SECONDS, scale=-6, annotation="UTC"))
    df = describe(df, "x", Described(Attribute.DOUBLE_64_TIMEINTERVAL_SECONDS))
    df = describe(df, "n", Described(Attribute.INT_64_TIME_SECONDS, scale="ns"))
    df = describe(df, "o", Described(Attribute.INT_32_TIME_OF_DAY_SECONDS))
    df = describe(df, "s", Described(Attribute.INT_32_BASE, scale=3))
    path = f"file://{tmp_path}/d"
    store.write_table(df, path)
    back = store.read_table(spark, path)
    assert description(back.schema["t"]) == Described(Attribute.INT_32_TIMESTAMP_SECONDS, -6, "UTC")
    got = back.select(meaning(back, "d").cast("string"), meaning(back, "t").cast("string"), meaning(back, "x").cast("string"), meaning(back, "o").cast("string"), meaning(back, "s")).collect()
    assert tuple(got[0]) == ("1970-01-02", "1970-01-01 00:00:00.000002", "INTERVAL '0 00:00:01.5' DAY TO SECOND", "01:00:00", 5000.0)
    assert tuple(got[1]) == (None,) * 5
    with pytest.raises(ValueError, match="no lossless"):
        meaning(back, "n")
    with pytest.raises(ValueError, match="needs int"):
        describe(df, "x", Described(Attribute.INT_32_DATE_DAYS))


def test_factors(spark, tmp_path):
    df = spark.createDataFrame([(1, "b"), (2, "zz"), (3, None), (4, "a")], "i int, f string")
    path = f"file://{tmp_path}/f"
    store.write_table(factors.as_factor(df, "f", ["b", "a"], ordered=True), path)
    back = store.read_table(spark, path)
    assert description(back.schema["f"]).levels == ("b", "a")
    assert [r.i for r in factors.order_by_level(back, "f").collect()][:2] == [1, 4]
    assert [r.f for r in factors.as_factor(df, "f", []).collect()] == [None] * 4
    widths = spark.createDataFrame([(127,), (128,), (32767,), (32768,)], "n long").select(factors.code_width(F.col("n")))
    assert [r[0] for r in widths.collect()] == [1, 2, 2, 4]


def test_catalog(spark, tmp_path):
    db = Database(spark, f"file://{tmp_path}/db")
    db.add_table(spark.range(10), "a/b", keys=["id"])
    db.add_table(spark.range(5), "c")
    assert db.names() == ["a/b", "c"]
    assert db.names("a") == ["a/b"]
    assert [r.id for r in db.table("a/b").slice(2, 4).arrange("id").df.collect()] == [1, 2, 3]
    db.table("c").rename("d")
    db.remove_table("a/b")
    assert db.names() == ["d"]
    for bad in ("../x", "", "a//b"):
        with pytest.raises(TableError):
            db.add_table(spark.range(1), bad)
    with pytest.raises(TableError):
        db.remove_table("c")
    assert db.table("d").compute("e").df.count() == 5
    assert db.table("d").compute().df.count() == 5


def test_chunks(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    with ChunkStream(spark, path, "w") as s:
        s.rbind(spark.range(0, 10).select("id", F.lit("x").alias("v")))
        s.rbind(spark.range(10, 15).select(F.lit("y").alias("v"), "id"))
        with pytest.raises(TableError):
            s.rbind(spark.range(3))
        assert s.meta_data().n_rows == 15
        s.cbind(spark.range(100, 115).withColumnRenamed("id", "w"), f"file://{tmp_path}/wide")
    got = store.read_table(spark, f"file://{tmp_path}/wide", None, 9, 12, in_order=True).collect()
    assert [tuple(r) for r in got] == [(8, "x", 108), (9, "x", 109), (10, "y", 110), (11, "y", 111)]
    with ChunkStream(spark, path, "r") as s, pytest.raises(TableError):
        s.rbind(spark.range(1))
    with pytest.raises(TableError):
        joins.bind_columns(spark.range(2), spark.range(3).withColumnRenamed("id", "x"))


def test_stream_appends_once(spark, tmp_path):
    source = f"file://{tmp_path}/in"
    spark.range(0, 20).write.parquet(source)
    out, check = f"file://{tmp_path}/out", f"file://{tmp_path}/check"
    for n in (20, 20, 35):
        if n == 35:
            spark.range(20, 35).write.mode("append").parquet(source)
        append_stream(spark.readStream.schema("id long").parquet(source), out, check).awaitTermination()
        assert sorted(r.id for r in store.read_table(spark, out).collect()) == list(range(n))


def test_failure_between_append_and_the_streams_own_mark(spark, tmp_path, monkeypatch):
    """A batch whose rows are stored before its query fails is not appended again."""
    source, out, check = f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/check"
    spark.range(0, 20).write.parquet(source)
    whole = ChunkStream.rbind

    def rbind(self, chunk):
        whole(self, chunk)
        raise RuntimeError("lost")

    monkeypatch.setattr(ChunkStream, "rbind", rbind)
    with pytest.raises(Exception, match="lost"):
        append_stream(spark.readStream.schema("id long").parquet(source), out, check).awaitTermination()
    monkeypatch.setattr(ChunkStream, "rbind", whole)
    append_stream(spark.readStream.schema("id long").parquet(source), out, check).awaitTermination()
    assert sorted(r.id for r in store.read_table(spark, out).collect()) == list(range(20))


def test_verbs(spark):
    df = spark.createDataFrame([(2, None), (1, "a"), (None, "b"), (2, None)], "k int, v string")
    t = Table(df).group_by("k")
    assert t.groups() == ["k"] and t.ungroup().groups() == []
    assert t.n_groups().first()[0] == 3
    assert [tuple(r) for r in t.group_size().collect()] == [(1, 1), (2, 2), (None, 1)]
    assert sorted((r.k or 9, r.group_index) for r in t.group_indices().df.collect()) == [(1, 1), (2, 2), (2, 2), (9, 3)]
    assert [r.k for r in verbs.arrange(df, "-k").collect()] == [2, 2, 1, None]
    assert Table(df).distinct().df.count() == 3
    assert sets.setequal(df, df.distinct()).first()[0] is True
    assert sets.setequal(df, df.where("k = 2")).first()[0] is False
    assert [r.k for r in verbs.slice_rows(df, 2, 3).collect()] == [1, None]
    with pytest.raises(ColumnNotFound):
        verbs.select(df, "K")
    big = spark.range(1000)
    assert verbs.sample_n(big, 10, ["id"]).collect() == verbs.sample_n(big.repartition(7), 10, ["id"]).collect()
    assert verbs.sample_frac(big, 1.0, ["id"]).count() == 1000 and verbs.sample_frac(big, 0.0, ["id"]).count() == 0
    collapsed = Table(df).filter("k = 2").collapse("two")
    assert spark.sql("SELECT count(*) FROM two").first()[0] == 2 == collapsed.df.count()


def test_threads(spark):
    before = runtime.set_threads(spark, 3)
    assert runtime.get_threads(spark) == 3 and runtime.set_threads(spark, 0) == 3
    assert runtime.get_threads(spark) == spark.sparkContext.defaultParallelism
    runtime.set_threads(spark, before)
    assert runtime.is_parallel(spark) and runtime.current_task() == 0
