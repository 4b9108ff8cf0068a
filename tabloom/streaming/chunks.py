"""A table grown by chunks: rows bound below it, columns bound beside it; and the sink of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import TableError
from ..operators.joins import bind_columns
from ..sources.store import ROW, SHIFT, TableMeta, extents, read_table, table_meta, write_parts, write_table


class ChunkStream:
    """``with ChunkStream(spark, path, "w") as s: s.rbind(chunk)``.

    Modes: ``r`` to read, ``w`` to start anew, ``a`` to go on.
    """

    def __init__(self, spark: SparkSession, path: str, mode: str = "r", compress: int = 0):
        self.spark, self.path, self.compress = spark, path, compress
        self.mode: str | None = None
        self.started = False
        self.open(path, mode)

    def open(self, path: str, mode: str) -> None:
        if mode not in ("r", "w", "a"):
            raise TableError(f"no such mode: {mode}")
        self.path, self.mode, self.started = path, mode, mode != "w"

    def close(self) -> None:
        self.mode = None

    def __enter__(self) -> ChunkStream:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _writing(self) -> None:
        if self.mode not in ("w", "a"):
            raise TableError("stream is not open for writing")

    def rbind(self, chunk: DataFrame) -> None:
        """Append rows; columns are matched by name. Only new files are written, and their ordinals go on from the last."""
        self._writing()
        if not self.started:
            write_table(chunk, self.path, self.compress)
            self.started = True
            return
        names = table_meta(self.spark, self.path).names
        if sorted(names) != sorted(chunk.columns):
            raise TableError("chunk has other columns")
        stored = self.spark.read.parquet(self.path)
        rows = chunk.select(*[F.col(f"`{c}`").cast(stored.schema[c].dataType).alias(c, metadata=stored.schema[c].metadata) for c in names])
        write_parts(rows, self.path, self.compress, stored.schema[ROW].metadata, self.next_part(), "append")

    def next_part(self) -> int:
        """The part that the next chunk begins with; 0 for a table that is not there yet."""
        if not self.started:
            return 0
        return 1 + max([p for p, _ in extents(self.spark, self.path, self.spark.read.parquet(self.path))], default=-1)

    def cbind(self, chunk: DataFrame, to: str) -> None:
        """Write the table with the chunk's columns beside its own to *to*, and go on there."""
        self._writing()
        write_table(bind_columns(read_table(self.spark, self.path, in_order=True), chunk), to, self.compress)
        self.path = to

    def meta_data(self) -> TableMeta:
        return table_meta(self.spark, self.path)


def append_stream(stream: DataFrame, path: str, checkpoint: str, compress: int = 0, available_now: bool = True) -> StreamingQuery:
    """Append the rows of a stream to a table, a chunk a micro-batch.

    Before a batch is appended, its number, the part that it begins with and its
    number of rows are noted. A batch that is run again after a failure finds its
    note: rows of that part and later ones are its own, and if they are all
    there it is not appended twice; if some are, the table is damaged.
    """

    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        files = spark._jvm.org.apache.hadoop.fs
        fs = files.Path(checkpoint).getFileSystem(spark._jsc.hadoopConfiguration())
        there = fs.exists(files.Path(f"{path}/_SUCCESS"))
        note = f"{checkpoint}/batches/{number}"
        rows = batch.persist()
        try:
            n = rows.count()
            if not n:
                return
            with ChunkStream(spark, path, "a" if there else "w", compress) as out:
                if fs.exists(files.Path(f"{note}/_SUCCESS")):
                    part, noted = spark.read.parquet(note).first()
                    stored = spark.read.parquet(path).where(F.col(ROW) >= part << SHIFT).count() if there else 0
                    if stored == noted:
                        return
                    if stored:
                        raise TableError(f"batch {number} was appended in part: {stored} of {noted} rows")
                spark.createDataFrame([(out.next_part(), n)], "part long, n long").coalesce(1).write.mode("overwrite").parquet(note)
                out.rbind(rows)
        finally:
            rows.unpersist()

    writer = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
