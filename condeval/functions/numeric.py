"""Number and dense-vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from condeval.functions.columns import ColumnLike, as_column


def signed3(value: ColumnLike) -> Column:
    """Display form such as ``+0.166``."""
    return F.format_string("%+.3f", as_column(value))


def zero_inside(low: ColumnLike, high: ColumnLike) -> Column:
    return F.lit(0.0).between(as_column(low), as_column(high))


def add_scaled(vector: ColumnLike, direction: ColumnLike, amount: ColumnLike) -> Column:
    """``vector + amount * direction``, element by element, in double."""
    amount = as_column(amount)
    return F.zip_with(
        as_column(vector), as_column(direction), lambda h, v: h.cast("double") + amount * v
    )


def dot(left: ColumnLike, right: ColumnLike) -> Column:
    products = F.zip_with(as_column(left), as_column(right), lambda x, y: x.cast("double") * y)
    return added(products)


def added(values: ColumnLike) -> Column:
    """The elements of an array of doubles, added from the first to the last."""
    return F.aggregate(as_column(values), F.lit(0.0), lambda total, x: total + x)
