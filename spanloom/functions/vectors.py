"""Vector functions over arrays of doubles, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def softmax(x: Column) -> Column:
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - top))
    return F.transform(e, lambda v: v / total(e))


def argmax(x: Column) -> Column:
    """Place of the largest value from 0, the first of equals."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def mean_square(x: Column, y: Column) -> Column:
    d = F.zip_with(x, y, lambda a, b: (a - b) * (a - b))
    return total(d) / F.size(d)


def rbf(x: Column, y: Column) -> Column:
    """The kernel exp(-mean((x - y)^2) / d)."""
    return F.exp(-mean_square(x, y) / F.size(x))


def kl_loss(mu: Column, logvar: Column) -> Column:
    """-0.5 * sum(1 + logvar - mu^2 - exp(logvar))."""
    return total(F.zip_with(mu, logvar, lambda m, v: F.lit(1.0) + v - m * m - F.exp(v))) * -0.5


def pad(x: Column, length: Column | int, value, left: bool = False) -> Column:
    n = F.greatest((F.lit(length) if isinstance(length, int) else length) - F.size(x), F.lit(0))
    fill = F.array_repeat(F.lit(value), n)
    return F.concat(fill, x) if left else F.concat(x, fill)


def round_up(n: Column, multiple: int) -> Column:
    return (F.ceil(n / F.lit(multiple)) * multiple).cast("int")


def shift_right(x: Column, start) -> Column:
    """x moved one place on, its last value gone, start in front."""
    return F.when(F.size(x) == 0, x).otherwise(F.concat(F.array(F.lit(start)), F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0)))))
