"""A catalog of stored tables in a folder; names with slashes make it hierarchical."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..errors import TableError
from .store import read_table, table_meta, write_table


class Database:
    """Tables under one folder, on any file system that Spark can write."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        """The file system and the path of a table, through Spark's own file layer."""
        parts = name.split("/")
        if not name or any(p in ("", ".", "..") for p in parts):
            raise TableError(f"bad table name '{name}'")
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def has(self, name: str) -> bool:
        fs, where = self._at(f"{name}/_SUCCESS")
        return fs.exists(where)

    def add_table(self, df: DataFrame, name: str, compress: int = 0, keys: list[str] | None = None) -> None:
        self._at(name)
        write_table(df, f"{self.path}/{name}", compress, keys)

    def remove_table(self, name: str) -> None:
        """Delete a table. A name that is not there is an error."""
        if not self.has(name):
            raise TableError(f"no table '{name}'")
        fs, where = self._at(name)
        fs.delete(where, True)

    def rename_table(self, old: str, new: str) -> None:
        if not self.has(old):
            raise TableError(f"no table '{old}'")
        if self.has(new):
            raise TableError(f"table '{new}' exists")
        fs, a = self._at(old)
        b = self._at(new)[1]
        fs.mkdirs(b.getParent())
        fs.rename(a, b)

    def read(self, name: str, columns: list[str] | None = None, from_row: int = 1, to_row: int = -1) -> DataFrame:
        return read_table(self.spark, f"{self.path}/{name}", columns, from_row, to_row)

    def table(self, name: str):
        """A lazy handle with the table verbs."""
        from ..plans.table import Table

        return Table(self.read(name), database=self, name=name)

    def names(self, under: str = "") -> list[str]:
        """All tables below a level, sorted."""
        found: list[str] = []
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{under}".rstrip("/"))
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        todo = [under.strip("/")]
        while todo:
            level = todo.pop()
            here = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{level}".rstrip("/"))
            if not fs.exists(here):
                continue
            if level and self.has(level):
                found.append(level)
                continue
            todo += [f"{level}/{s.getPath().getName()}".strip("/") for s in fs.listStatus(here) if s.isDirectory()]
        return sorted(found)

    def table_index(self, under: str = "") -> DataFrame:
        """One row a table: name, n_rows, n_cols, columns, keys."""
        rows = []
        for name in self.names(under):
            m = table_meta(self.spark, f"{self.path}/{name}")
            rows.append((name, m.n_rows, len(m.names), ",".join(m.names), ",".join(m.keys)))
        return self.spark.createDataFrame(rows, "name string, n_rows long, n_cols int, columns string, keys string")
