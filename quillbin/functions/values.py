"""Numbers read from text, fixed-width hex, and comparison of values whose type is known at run time only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A value of any type: kind is int, bool, float, str or null (no value).
DYNAMIC = "struct<kind:string,i:bigint,b:boolean,f:double,s:string>"
MOST_UNSIGNED = (1 << 64) - 1


def parse_uint(text: Column) -> Column:
    """An unsigned 64-bit number in decimal digits alone, as decimal(20,0); null if the text is anything else or too large."""
    digits = F.regexp_replace(text, "^0+(?=.)", "")
    value = F.when(F.length(digits) <= 20, digits).try_cast("decimal(20,0)")
    return F.when(F.regexp_like(text, F.lit(r"\A[0-9]+\z")) & (value <= F.lit(str(MOST_UNSIGNED)).cast("decimal(20,0)")), value)


def parse_int(text: Column) -> Column:
    """As parse_uint, signed: a minus may stand before, and the value fits into 64 bits."""
    below = F.startswith(text, F.lit("-"))
    size = parse_uint(F.when(below, F.substring(text, 2, 1 << 30)).otherwise(text))
    return F.when(below, -size).otherwise(size).try_cast("bigint")


def put_hex(number: Column, digits: int) -> Column:
    """The last `digits` hexadecimal digits of a number, upper case."""
    mask = F.lit((1 << 4 * digits) - 1) if digits < 16 else F.lit(-1)
    return F.lpad(F.hex(number.cast("bigint").bitwiseAND(mask)), digits, "0")


def get_hex(text: Column) -> Column:
    """The number that hexadecimal digits of either case spell."""
    return F.conv(text, 16, 10).cast("bigint")


def _kind(kind: str, **held: Column) -> Column:
    types = {"i": "bigint", "b": "boolean", "f": "double", "s": "string"}
    return F.struct(F.lit(kind).alias("kind"), *(held.get(c, F.lit(None)).cast(t).alias(c) for c, t in types.items()))


def int_value(x: Column) -> Column:
    return _kind("int", i=x)


def bool_value(x: Column) -> Column:
    return _kind("bool", b=x)


def float_value(x: Column) -> Column:
    return _kind("float", f=x)


def str_value(x: Column) -> Column:
    return _kind("str", s=x)


def _as_int(v: Column) -> Column:
    return F.when(v["kind"] == "int", v["i"]).when(v["kind"] == "bool", v["b"].cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def _of_bits(n: Column) -> Column:
    """The double whose 64 bits are those of n."""
    exponent, part = F.shiftrightunsigned(n, 52).bitwiseAND(F.lit(2047)), n.bitwiseAND(F.lit((1 << 52) - 1)).cast("double")
    normal = (1 + part / float(1 << 52)) * F.pow(F.lit(2.0), exponent - 1023)
    size = F.when(exponent == 0, part * 5e-324).when(exponent < 2047, normal).when(part == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return F.when(n < 0, -size).otherwise(size)


def _as_float(v: Column) -> Column:
    """A value that is no float is read bit by bit: a string by its length in bytes, nothing by zero."""
    bits = F.when(v["kind"] == "str", F.octet_length(v["s"])).otherwise(_as_int(v)).cast("bigint")
    return F.when(v["kind"] == "float", v["f"]).otherwise(_of_bits(bits))


def _as_str(v: Column) -> Column:
    return F.when(v["kind"] == "str", v["s"]).otherwise(F.lit(""))


def compare(op: str, x: Column, y: Column) -> Column:
    """x op y (one of > >= < <=), by the type of x: ints as ints (bools are 0 and 1, others 0), floats as floats (NaN is never larger or smaller), and all else
    as strings by bytes (what is no string is empty)."""
    test = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}[op]
    a, b = _as_float(x), _as_float(y)
    floats = test(a, b) & ~F.isnan(a) & ~F.isnan(b)
    kind = F.coalesce(x["kind"], F.lit(""))
    return F.when(kind == "int", test(_as_int(x), _as_int(y))).when(kind == "float", floats).otherwise(test(_as_str(x), _as_str(y)))
