"""The histogram's buckets: the upper 16 bits of order-preserving float32, as closed arithmetic forms that stay in code generation.

A bucket holds the floats that agree in sign, exponent and seven bits of mantissa. All steps are exact in double precision.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = 32768
_TINY = 2.0**-126


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_counted(value: str | Column) -> Column:
    """NaN, infinities and nulls are not counted. The value counts as float32."""
    v = _col(value).cast("float")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def bucket_of(value: str | Column) -> Column:
    """Bucket (0..65535, ascending with the value) of a counted value."""
    v = _col(value).cast("float")
    a = F.abs(v.cast("double"))
    guess = F.floor(F.log2(a))
    e = guess - (F.pow(F.lit(2.0), guess) > a).cast("long") + (F.pow(F.lit(2.0), guess + 1) <= a).cast("long")
    normal = (e + 127) * 128 + F.floor((a / F.pow(F.lit(2.0), e) - 1) * 128)
    mag = F.when(a < _TINY, F.floor(a * (2.0**126) * 128)).otherwise(normal)
    below = (v < 0) | ((v == 0) & F.startswith(v.cast("string"), F.lit("-")))
    return F.when(below, 32767 - mag).otherwise(ZERO + mag).cast("int")


def _value(bucket: Column, above: float, below: float) -> Column:
    up = bucket >= ZERO
    mag = F.when(up, bucket - ZERO).otherwise(32767 - bucket)
    ex, m = F.floor(mag / 128), F.pmod(mag, F.lit(128))
    part = (m + F.when(up, F.lit(above)).otherwise(F.lit(below))) / 128
    size = F.when(ex == 0, part * _TINY).otherwise((1 + part) * F.pow(F.lit(2.0), ex - 127))
    return F.when(up, size).otherwise(-size)


def low_of(bucket: str | Column) -> Column:
    """The bucket's lower edge."""
    return _value(_col(bucket), 0.0, 65535 / 65536)


def mid_of(bucket: str | Column) -> Column:
    """The bucket's middle."""
    return _value(_col(bucket), 0.5, 32767 / 65536)
