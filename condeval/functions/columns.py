"""Small helpers for column arguments."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def as_column(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def as_list(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def all_present(names: Sequence[str]) -> Column:
    """True where none of the named columns is NULL."""
    return reduce(lambda a, b: a & b, (F.col(n).isNotNull() for n in names), F.lit(True))


def value_map(value: ColumnLike, mapping: dict[str, str]) -> Column:
    """CASE over a small mapping; unmapped values become NULL."""
    mapped = F.lit(None).cast("string")
    for key, target in mapping.items():
        mapped = F.when(as_column(value) == key, F.lit(target)).otherwise(mapped)
    return mapped


def free_names(taken: Sequence[str], *wanted: str) -> list[str]:
    """The wanted column names, each with as many underscores before it as make it new."""
    seen, names = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in seen:
            name = "_" + name
        seen.add(name.lower())
        names.append(name)
    return names
