"""Quantization and distances of vectors of any length."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 10000.0
LEAST, MOST = -32768, 32767


def quantize(v: Column) -> Column:
    """round(v * 10000) away from zero at halves, within 16 bits; NaN is 0."""
    x = F.round((v.cast("float") * F.lit(SCALE).cast("float")).cast("float"))
    return F.when(F.isnan(x), 0).otherwise(F.greatest(F.lit(LEAST), F.least(F.lit(MOST), x)).cast("int"))


def quantize_vector(v: Column) -> Column:
    return F.transform(v, quantize)


def columns(v: Column, dims: int, prefix: str = "q") -> list[Column]:
    """The vector as columns of their own: sums over them compile, array functions don't."""
    return [v[i].alias(f"{prefix}{i}") for i in range(dims)]


def squared_distance(a: list[Column], b: list[Column]) -> Column:
    """Sum of squared differences of integers, exact in 64 bits."""
    def one(x: Column, y: Column) -> Column:
        d = x.cast("long") - y.cast("long")
        return d * d

    return reduce(lambda s, t: s + t, (one(x, y) for x, y in zip(a, b, strict=True)))


def first_greatest(values: Column) -> Column:
    """0-based place of the first greatest element."""
    return F.array_position(values, F.array_max(values)) - 1


def align_up(n: Column, block: int) -> Column:
    return (F.ceil(n / block) * block).cast("long")
