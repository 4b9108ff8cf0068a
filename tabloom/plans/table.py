"""A lazy table with the table verbs: a DataFrame and its grouping."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from ..operators import groups as g
from ..operators import joins, sets, verbs


class Table:
    """Every verb gives a new table; nothing runs until rows are asked for."""

    def __init__(self, df: DataFrame, groups: tuple[str, ...] = (), database=None, name: str | None = None):
        self.df, self._groups, self._database, self.name = df, tuple(groups), database, name

    def _new(self, df: DataFrame) -> Table:
        return Table(df, tuple(k for k in self._groups if k in df.columns), self._database)

    # Projection and filter.
    def select(self, *columns: str) -> Table:
        return self._new(verbs.select(self.df, *columns))

    def mutate(self, **columns: Column) -> Table:
        return self._new(verbs.mutate(self.df, **columns))

    def rename_columns(self, **new_to_old: str) -> Table:
        return self._new(verbs.rename(self.df, **new_to_old))

    def rename(self, table_name: str) -> Table:
        """Rename the stored table that this is a handle of."""
        if self._database is None or self.name is None:
            raise ValueError("not a stored table")
        self._database.rename_table(self.name, table_name)
        return self._database.table(table_name)

    def pull(self, column: str) -> DataFrame:
        return verbs.pull(self.df, column)

    def filter(self, *conditions: Column | str) -> Table:
        return self._new(verbs.where(self.df, *conditions))

    def slice(self, from_row: int, to_row: int = -1) -> Table:
        """Rows by ordinal; on a stored table the store's own ordinals are used, which prune."""
        if self._database is not None and self.name is not None:
            return self._new(self._database.read(self.name, None, from_row, to_row))
        return self._new(verbs.slice_rows(self.df, from_row, to_row))

    def arrange(self, *keys: str | Column) -> Table:
        return self._new(verbs.arrange(self.df, *keys))

    def distinct(self, *columns: str) -> Table:
        return self._new(verbs.distinct(self.df, *columns))

    def sample_n(self, n: int, key: list[str], seed: int = 0) -> Table:
        return self._new(verbs.sample_n(self.df, n, key, seed))

    def sample_frac(self, fraction: float, key: list[str], seed: int = 0) -> Table:
        return self._new(verbs.sample_frac(self.df, fraction, key, seed))

    # Grouping.
    def group_by(self, *keys: str) -> Table:
        verbs.resolve(self.df.columns, list(keys))
        return Table(self.df, keys, self._database, self.name)

    def ungroup(self) -> Table:
        return Table(self.df, (), self._database, self.name)

    def groups(self) -> list[str]:
        return list(self._groups)

    def n_groups(self) -> DataFrame:
        return g.n_groups(self.df, self.groups())

    def group_size(self) -> DataFrame:
        return g.group_size(self.df, self.groups())

    def group_indices(self, name: str = "group_index") -> Table:
        return self._new(g.group_indices(self.df, self.groups(), name))

    def summarise(self, **values: Column) -> Table:
        return Table(g.summarise(self.df, self.groups(), **values), (), self._database)

    def do(self, function: Callable, schema: str) -> Table:
        return Table(g.do_per_group(self.df, self.groups(), function, schema), (), self._database)

    # Two tables.
    def _both(self, verb: Callable, other: Table, *args) -> Table:
        return self._new(verb(self.df, other.df, *args))

    def inner_join(self, other: Table, on) -> Table:
        return self._both(joins.inner_join, other, on)

    def left_join(self, other: Table, on) -> Table:
        return self._both(joins.left_join, other, on)

    def right_join(self, other: Table, on) -> Table:
        return self._both(joins.right_join, other, on)

    def full_join(self, other: Table, on) -> Table:
        return self._both(joins.full_join, other, on)

    def semi_join(self, other: Table, on) -> Table:
        return self._both(joins.semi_join, other, on)

    def anti_join(self, other: Table, on) -> Table:
        return self._both(joins.anti_join, other, on)

    def bind_columns(self, other: Table) -> Table:
        return self._both(joins.bind_columns, other)

    def union(self, other: Table) -> Table:
        return self._both(sets.union, other)

    def union_all(self, other: Table) -> Table:
        return self._both(sets.union_all, other)

    def intersect(self, other: Table) -> Table:
        return self._both(sets.intersect, other)

    def setdiff(self, other: Table) -> Table:
        return self._both(sets.setdiff, other)

    def setequal(self, other: Table) -> DataFrame:
        return sets.setequal(self.df, other.df)

    # Materialisation.
    def collapse(self, view: str | None = None) -> Table:
        """Name the pending plan as a temporary view, for SQL, and go on from it."""
        view = view or f"table_{uuid.uuid4().hex}"
        self.df.createOrReplaceTempView(view)
        return Table(self.df.sparkSession.table(view), self._groups, self._database, None)

    def compute(self, name: str | None = None, compress: int = 0) -> Table:
        """Run the plan now: into a stored table of the catalog, or a cache that can be rebuilt from the plan."""
        if name is not None and self._database is not None:
            self._database.add_table(self.df, name, compress)
            return Table(self._database.read(name), self._groups, self._database, name)
        kept = self.df.persist()
        kept.count()
        return Table(kept, self._groups, self._database)
