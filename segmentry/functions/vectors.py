"""Vector expressions on array columns, in double."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def inner_product(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")))


def sq_l2(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(_col(a), _col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def norm(a: Column | str) -> Column:
    return F.sqrt(_sum(F.transform(_col(a), lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(inner_product(a, b), norm(a) * norm(b))


def rounded(c: Column | str, digits: int) -> Column:
    """As ``std::round`` and DuckDB: the double ``c * 10^digits`` to the next whole number, halves away from zero. Spark's round takes the
    decimal that a double is printed as, which for some halves gives the other neighbour."""
    return F.round(_col(c) * 10.0**digits) / 10.0**digits


def l2_normalize(a: Column | str) -> Column:
    """Unit length; a zero vector stays zero."""
    size = F.transform(F.array(norm(a)), lambda n: F.transform(_col(a), lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x.cast("double") / n)))
    return size[0]
