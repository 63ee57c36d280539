"""Vector mathematics as Column builders.

All sums run in double and in component order, so that results do not depend on
partitioning and equal those of any engine that does the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Norms up to these leave a vector as it is, or bound the divisor.
EPSILON = 1.1920928955078125e-07
EPSILON_EMBEDDING = 1e-6
EPSILON_SMALL = 1e-10


def col(v: str | Column) -> Column:
    return F.col(v) if isinstance(v, str) else v


def vector(values: Sequence[float]) -> Column:
    """A literal vector of doubles."""
    return F.array(*(F.lit(float(x)) for x in values)) if len(values) else F.array().cast("array<double>")


def _fold(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product."""
    return _fold(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")))


def l2_squared(a: str | Column, b: str | Column) -> Column:
    def square(x: Column, y: Column) -> Column:
        return (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))

    return _fold(F.zip_with(col(a), col(b), square))


def l2(a: str | Column, b: str | Column) -> Column:
    return F.sqrt(l2_squared(a, b))


def norm_squared(v: str | Column) -> Column:
    return _fold(F.transform(col(v), lambda x: x.cast("double") * x.cast("double")))


def norm(v: str | Column) -> Column:
    return F.sqrt(norm_squared(v))


def cosine(a: str | Column, b: str | Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def normalize(v: str | Column, epsilon: float = EPSILON) -> Column:
    """Unit vector; as it is if its norm is not over ``epsilon``."""
    size = norm(v)
    return F.when(size > epsilon, F.transform(col(v), lambda x: x.cast("double") / size)).otherwise(F.transform(col(v), lambda x: x.cast("double")))


def normalize_bounded(v: str | Column, epsilon: float = EPSILON_SMALL) -> Column:
    """Divided by the norm, or by ``epsilon`` if that is larger."""
    size = F.greatest(norm(v), F.lit(epsilon))
    return F.transform(col(v), lambda x: x.cast("double") / size)


def is_normalized(v: str | Column, tolerance: float = 1e-4) -> Column:
    return F.abs(norm_squared(v) - 1.0) < tolerance


def has_dimension(v: str | Column, dim: int) -> Column:
    return F.coalesce(F.size(col(v)) == dim, F.lit(False))


def check_dimension(v: str | Column, dim: int, row: str | Column) -> Column:
    """The vector, or an error that names the row."""
    text = F.concat(F.lit(f"dimension mismatch: expected {dim}, got "), F.size(col(v)).cast("string"), F.lit(" in row "), col(row).cast("string"))
    return F.when(has_dimension(v, dim), col(v)).otherwise(F.raise_error(text))


def subvectors(v: str | Column, parts: int, size: int) -> Column:
    """``parts`` consecutive slices of ``size`` components."""
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda s: F.slice(col(v), s * size + 1, F.lit(size)))


def nearest(v: str | Column, centroids: str | Column) -> Column:
    """Index of the centroid with the least squared distance, the lowest of equals."""
    return F.array_min(F.transform(col(centroids), lambda c, i: F.struct(l2_squared(v, c).alias("d"), i.alias("i"))))["i"]
