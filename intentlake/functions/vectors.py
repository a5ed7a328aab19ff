"""Vector expressions over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shorter vectors stay as they are when normalised.
LEAST_NORM = 1e-12


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def dot(v: Column, w: Column) -> Column:
    """Sum of products; null if a side is null, or if their widths differ."""
    products = F.zip_with(v, w, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda a, x: a + x)


def normalized(v: Column) -> Column:
    """Divided by its length; a zero vector stays zero."""
    length = norm(v)
    return F.transform(v, lambda x: F.when(length > LEAST_NORM, x.cast("double") / length).otherwise(x.cast("double")))


def cosine(v: Column, w: Column) -> Column:
    """Dot product of the normalised sides: 0 for a zero vector."""
    a, b = norm(v), norm(w)
    scale = F.when(a > LEAST_NORM, a).otherwise(F.lit(1.0)) * F.when(b > LEAST_NORM, b).otherwise(F.lit(1.0))
    return dot(v, w) / scale


def literal(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])
