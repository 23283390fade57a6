"""Vector expressions on ARRAY<DOUBLE> columns, computed inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(vec: str | Column) -> Column:
    return _col(vec).cast("array<double>")


def dot(a: str | Column, b: str | Column) -> Column:
    products = F.zip_with(_col(a), _col(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def squared_distance(a: str | Column, b: str | Column) -> Column:
    squares = F.zip_with(_col(a), _col(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x)


def norm(vec: str | Column) -> Column:
    return F.sqrt(F.aggregate(_col(vec), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(vec: str | Column) -> Column:
    """Unit vector; a zero vector stays zero."""
    vec = as_double(vec)
    # The length is bound to a lambda variable, or it would be taken again per element.
    scaled = F.transform(
        F.array(norm(vec)),
        lambda size: F.when(size > 0, F.transform(vec, lambda x: x / size)).otherwise(vec),
    )
    return F.get(scaled, F.lit(0))
