"""Mean-difference directions over a table of dense vectors, and shifts along them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from condeval.functions.columns import as_list
from condeval.functions.numeric import add_scaled, added, dot
from condeval.operators.exact import class_means
from condeval.operators.grid import COEFFICIENTS, condition_grid
from condeval.operators.rates import label_rates


def direction(vectors: DataFrame, positive: Column, vector: str = "embedding") -> DataFrame:
    """One row: unit direction from the other class's mean to the positive class's mean.

    ``positive`` marks one class and every other row, NULL included, is the other
    class. Rows without a vector are dropped. Columns: ``v`` (unit vector), ``s``
    (norm of the mean difference), ``midpoint`` (projection of the point halfway
    between the means) and the two class sizes. ``v`` and ``midpoint`` are NULL
    when the means coincide; an empty class or vectors of unequal length fail.

    Sums are exact, so the result is the same to the last bit for any partitioning: each
    task sends one row a class, with one sum a position, and no row an element.
    """
    means = class_means(vectors, positive, vector)
    whole = means.agg(
        *(
            F.any_value(F.when(F.col("positive") == mark, F.col(column)), F.lit(True)).alias(f"_{name}{side}")
            for mark, side in ((True, 1), (False, 0))
            for name, column in (("n", "n"), ("m", "means"))
        ),
        (F.min("even") & (F.min(F.size("means")) == F.max(F.size("means")))).alias("_even"),
    )
    checked = whole.filter(
        F.assert_true(
            F.col("_n1").isNotNull() & F.col("_n0").isNotNull(), "a class of the contrast has no vectors"
        ).isNull()
        & F.assert_true(F.col("_even"), "the vectors differ in length").isNull()
    )
    gaps = F.zip_with("_m1", "_m0", lambda a, b: a - b)
    squares = F.transform("_gap", lambda g: g * g)
    centres = F.zip_with("_gap", F.zip_with("_m1", "_m0", lambda a, b: a + b), lambda g, c: g * c)
    found = checked.withColumn("_gap", gaps).withColumns({"s": F.sqrt(added(squares)), "_centre": added(centres) / 2})
    unit = F.transform("_gap", lambda g: g / F.col("s"))
    return found.select(
        F.when(F.col("s") > 0, unit).alias("v"),
        "s",
        F.try_divide("_centre", "s").alias("midpoint"),
        F.col("_n1").alias("n_positive"),
        F.col("_n0").alias("n_other"),
    )


def one_row(table: DataFrame, *columns: str) -> Column:
    """The single row of a table as a struct-valued scalar subquery.

    It runs once and is inlined as a literal, so using it needs no join.
    """
    return table.select(F.struct(*columns)).scalar()


def shift_vectors(
    vectors: DataFrame,
    along: DataFrame,
    coefficient: Column | float,
    vector: str = "embedding",
    shifted: str = "shifted",
) -> DataFrame:
    """Add ``coefficient * s * v`` to every vector; coefficient 0 leaves it as it is."""
    found = F.col("_along")
    factor = coefficient if isinstance(coefficient, Column) else F.lit(float(coefficient))
    moved = add_scaled(vector, found["v"], factor * found["s"])
    same = F.transform(vector, lambda x: x.cast("double"))
    held = vectors.withColumn("_along", one_row(along, "v", "s"))
    return held.withColumn(shifted, F.when(factor == 0, same).otherwise(moved)).drop("_along")


def shift_sweep(
    vectors: DataFrame,
    along: DataFrame,
    keys: str | Sequence[str] = (),
    coefficients: Sequence[float] = COEFFICIENTS,
    vector: str = "embedding",
    condition: str = "coefficient",
) -> DataFrame:
    """Label rates after shifting every vector by each coefficient.

    A shifted vector is FIGURATIVE when its projection on the direction lies
    beyond the midpoint of the class means, else LITERAL. The direction has
    length 1, so the projection of ``h + c*s*v`` is that of ``h`` plus ``c*s``:
    each vector is read and projected once, and only that number meets the grid.
    """
    keys = as_list(keys)
    found = F.col("_along")
    held = vectors.filter(F.col(vector).isNotNull()).withColumn(
        "_along", one_row(along, "v", "s", "midpoint")
    )
    projected = held.select(
        *keys,
        (dot(vector, found["v"]) - found["midpoint"]).alias("_beyond"),
        found["s"].alias("_s"),
    )
    cells = condition_grid(projected, coefficients, condition)
    moved = F.col("_beyond") + F.col(condition) * F.col("_s")
    label = F.when(moved > 0, "FIGURATIVE").otherwise("LITERAL")
    return label_rates(cells.withColumn("_label", label), [*keys, condition], "_label")
