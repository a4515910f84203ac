"""Column functions over growable lists of unsigned 32-bit cells, as array<long>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.operators.sorted_index import uint32

# Cells that a list grows by, room that it keeps, and the most that it may hold.
STEP, ROOM, MOST = 4096, 128, 2**32 - 1


def cell(cells: Column, i: Column) -> Column:
    """The cell at a place from 0; null out of range, below 0 too."""
    return F.when(i >= 0, F.get(cells, i))


def set_cell(cells: Column, i: Column, value: Column) -> Column:
    """The list with one cell replaced; a place out of range fails the query."""
    bad = (i < 0) | (i >= F.size(cells))
    new = F.concat(F.slice(cells, F.lit(1), i), F.array(uint32(value)), F.slice(cells, i + 2, F.size(cells)))
    return F.when(bad, F.raise_error(F.lit("Index out of bounds")).cast("array<bigint>")).otherwise(new)


def push(cells: Column, value: Column) -> Column:
    return F.array_append(cells, uint32(value))


def popped(cells: Column) -> Column:
    """The last cell; null of an empty list."""
    return F.get(cells, F.size(cells) - 1)


def without_last(cells: Column) -> Column:
    return F.slice(cells, F.lit(1), F.greatest(F.size(cells) - 1, F.lit(0)))


def grown(length: Column, capacity: Column) -> Column:
    """The capacity after a look at the length: doubled, in whole steps, where little room is left."""
    double = F.ceil(capacity * 2 / STEP) * STEP
    most = F.when(double > MOST, F.raise_error(F.lit("Array size exceeds the maximum limit")).cast("bigint")).otherwise(double)
    return F.when(length + ROOM >= capacity, most).otherwise(capacity).cast("long")


def index_of(cells: Column, value: Column) -> Column:
    """The first place of a value, from 0; -1 where there is none."""
    return (F.array_position(cells, value) - 1).cast("long")
