"""Errors of the table store and of blobs. All are ValueErrors."""

from __future__ import annotations

# The messages that readers report.
NOT_POSITIVE = "Parameter fromRow should have a positive value."
OUT_OF_RANGE = "Row selection is out of range."
BAD_RANGE = "Incorrect row range specified."
NO_COLUMN = "Column '{}' not found"
NO_DATA = "Source contains no data."


class TableError(ValueError):
    """A table could not be opened or read as asked."""


class ColumnNotFound(TableError):
    def __init__(self, name: str):
        super().__init__(NO_COLUMN.format(name))
        self.name = name


class RowRangeError(TableError):
    """A row range that does not fit the table."""


class BlobError(ValueError):
    """A compressed value is damaged, or there is nothing to hash."""
