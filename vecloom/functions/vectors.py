"""Column functions over vectors kept as ``array<double>``; all run in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(x: Column | str) -> Column:
    """The elements as doubles."""
    return F.transform(x, lambda e: e.cast("double"))


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product, summed from the left."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def total(x: Column | str) -> Column:
    """Sum of the elements."""
    return F.aggregate(x, F.lit(0.0), lambda s, e: s + e)


def norm(x: Column | str) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, e: s + e * e))


def scaled(x: Column | str, by: Column) -> Column:
    return F.transform(x, lambda e: e * by)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; inside a lambda it would be computed for each element."""
    return F.transform(F.array(value), body)[0]


def unit(x: Column | str, floor: float = 1e-12) -> Column:
    """The vector over its length; lengths below ``floor`` count as ``floor``, so zero stays zero."""
    return let(F.greatest(norm(x), F.lit(floor)), lambda n: F.transform(x, lambda e: e / n))


def plus(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, e: s + e)


def mean_vector(x: Column | str) -> Column:
    """Aggregate: the mean of vectors, with partial sums before the shuffle."""
    return vector_to_array(Summarizer.mean(array_to_vector(F.col(x) if isinstance(x, str) else x)))


def sum_vector(x: Column | str) -> Column:
    """Aggregate: the sum of vectors."""
    return vector_to_array(Summarizer.sum(array_to_vector(F.col(x) if isinstance(x, str) else x)))


def weighted_mean_vector(x: Column | str, w: Column | str) -> Column:
    """Aggregate: the mean of vectors by weight."""
    return vector_to_array(Summarizer.mean(array_to_vector(F.col(x) if isinstance(x, str) else x), F.col(w) if isinstance(w, str) else w))


def softmax(x: Column | str) -> Column:
    """Softmax of the elements, shifted by the largest."""
    powers = let(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top)))
    return let(powers, lambda e: let(total(e), lambda z: F.transform(e, lambda v: v / z)))


def argmax(x: Column | str) -> Column:
    """Place from 0 of the first largest element."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")
