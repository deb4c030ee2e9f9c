"""Functions of arrays that read them once, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """A function of a value that is computed once, however often the function names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _starts(values: Column, begins: Callable[[Column, Column], Column]) -> Column:
    return F.filter(F.transform(values, lambda v, i: F.when((i == 0) | begins(F.get(values, i - 1), v), i)), lambda i: i.isNotNull())


def runs(values: Column, begins: Callable[[Column, Column], Column]) -> Column:
    """The parts of an array, each from a value that begins one, given the value before it, up to the next such value."""
    return let(_starts(values, begins), lambda at: F.transform(at, lambda a, j: F.slice(values, a + 1, F.coalesce(F.get(at, j + 1), F.size(values)) - a)))


def counted(terms: Column) -> Column:
    """array<struct<term, tf>>: the distinct values of an array, sorted, and how often each occurs."""
    count = lambda s, at: F.transform(at, lambda a, j: F.struct(F.get(s, a).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(s)) - a).cast("long").alias("tf")))
    return let(F.sort_array(terms), lambda s: let(_starts(s, lambda a, b: a != b), lambda at: count(s, at)))
