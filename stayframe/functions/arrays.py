"""Array columns: padding, flattening, reshaping, encoding."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, functions as F


def zero_vector(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), dim)


def default_vector(vector, dim: int) -> Column:
    """The vector as ``array<float>``, or ``dim`` zeros where there is none."""
    return F.coalesce(_col(vector).cast("array<float>"), zero_vector(dim))


def repeat_value(value, n: int) -> Column:
    """The value n times, as an array."""
    return F.array_repeat(_col(value), n)


def flatten_seq(vectors) -> Column:
    """A list of vectors as one flat ``array<float>``."""
    return F.flatten(_col(vectors)).cast("array<float>")


def dense_u8(vector) -> Column:
    """A Spark ML vector as a dense array of small integers.

    Values are cut to whole numbers and wrap at 256, as unsigned bytes do.
    """
    wide = F.transform(vector_to_array(_col(vector)), lambda x: F.pmod(x.cast("int"), F.lit(256)))
    return wide.cast("array<smallint>")


def last_n_reshape(flat, steps: int = 100, dim: int = 10) -> Column:
    """The last ``steps * dim`` values, as ``steps`` rows of ``dim``."""
    flat = _col(flat)
    start = F.greatest(F.size(flat) - steps * dim, F.lit(0))
    return F.transform(
        F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.slice(flat, start + i * dim + 1, F.lit(dim))
    )


def one_hot(label, depth: int = 2) -> Column:
    """1 at the label's position, 0 elsewhere."""
    label = _col(label)
    return F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda i: (i == label).cast("int"))


def mean_pool(flat, steps: int, dim: int) -> Column:
    """Mean over the steps of a flat ``steps * dim`` sequence, one value per dimension."""
    flat = _col(flat)

    def mean_of(j):
        column = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.get(flat, i * dim + j))
        return F.aggregate(column, F.lit(0.0), lambda total, x: total + x.cast("double")) / steps

    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), mean_of)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c
