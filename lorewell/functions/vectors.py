"""Similarities and int8 quantisation as column expressions over ARRAY columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

_UNROLL = 128  # longer vectors use higher-order functions; shorter ones against a constant stay in generated code


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dot_with(a: Column, values: list[float]) -> Column:
    """The same against a constant vector."""
    if len(values) > _UNROLL:
        return dot(a, F.array(*(F.lit(float(v)) for v in values)))
    return reduce(lambda s, t: s + t, (F.get(a, F.lit(i)).cast("double") * F.lit(float(v)) for i, v in enumerate(values)))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def cosine_with(a: Column, values: list[float]) -> Column:
    size = sum(float(v) * float(v) for v in values) ** 0.5
    return F.coalesce(F.try_divide(dot_with(a, values), norm(a) * F.lit(size)), F.lit(0.0))


def scale(v: Column) -> Column:
    """Largest magnitude over 127, in single precision."""
    return (F.array_max(F.transform(v, lambda x: F.abs(x))) / F.lit(127.0).cast("float")).cast("float")


def quantize(v: Column, by: Column | None = None) -> Column:
    """array<tinyint>: multiples of the scale, halves away from zero; a zero vector gives zeros."""
    by = scale(v) if by is None else by
    return F.transform(v, lambda x: F.when(by == 0, F.lit(0)).otherwise(F.round(F.try_divide(x, by).cast("float"))).cast("tinyint"))


def int_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("long") * y.cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def cosine_int8(a: Column, b: Column) -> Column:
    """Cosine of quantised vectors from whole-number sums; scales cancel."""
    return F.coalesce(F.try_divide(int_dot(a, b).cast("double"), F.sqrt(int_dot(a, a).cast("double")) * F.sqrt(int_dot(b, b).cast("double"))), F.lit(0.0))


def dot_int8(a: Column, scale_a: Column, b: Column, scale_b: Column) -> Column:
    return int_dot(a, b).cast("double") * scale_a.cast("double") * scale_b.cast("double")
