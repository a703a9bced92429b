from pyspark.sql import functions as F

from quillbin.functions import values as V


def test_parse(spark):
    cases = {
        "0": (0, 0), "00017": (17, 17), "-5": (None, -5), "-0": (None, 0), "": (None, None), "-": (None, None), "+1": (None, None), " 1": (None, None), "1\n": (None, None), "1.0": (None, None), "٣": (None, None),
        "9223372036854775807": (2**63 - 1, 2**63 - 1), "9223372036854775808": (2**63, None), "-9223372036854775808": (None, -(2**63)), "-9223372036854775809": (None, None),
        "18446744073709551615": (2**64 - 1, None), "18446744073709551616": (None, None), "0" * 40 + "7": (7, 7), "9" * 50: (None, None),
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", V.parse_uint(F.col("t")).alias("u"), V.parse_int(F.col("t")).alias("i")).collect()
    assert {r.t: (None if r.u is None else int(r.u), r.i) for r in rows} == cases


def test_compare(spark):
    n = lambda kind, x: {"int": V.int_value, "float": V.float_value, "str": V.str_value, "bool": V.bool_value}[kind](F.lit(x))
    cases = [
        (">", ("int", 3), ("int", 2), True), (">", ("int", 0), ("str", "z"), False), (">=", ("int", 0), ("float", 9.5), True), ("<", ("int", 0), ("bool", True), True),
        (">", ("float", 0.0), ("int", 5), False), ("<", ("float", 0.0), ("int", 5), True), (">", ("float", float("nan")), ("float", 1.0), False), ("<=", ("float", float("nan")), ("float", float("nan")), False),
        ("<", ("float", 1.0), ("int", 0x4000000000000000), True), (">", ("str", "b"), ("str", "a"), True), (">", ("str", "b"), ("int", 7), True), ("<=", ("bool", True), ("int", 0), True), ("<", ("bool", False), ("str", "x"), True),
        ("<", ("int", 1), None, False), (">", None, ("str", ""), False), ("<=", None, None, True),
    ]
    made = [V.compare(op, *(F.lit(None).cast(V.DYNAMIC) if v is None else n(*v) for v in (x, y))).alias(f"c{k}") for k, (op, x, y, _) in enumerate(cases)]
    got = spark.range(1).select(*made).first()
    assert [bool(g) for g in got] == [w for *_, w in cases]


def test_hex(spark):
    r = spark.range(1).select(V.put_hex(F.lit(0xBEEF12), 4).alias("a"), V.put_hex(F.lit(7), 8).alias("b"), V.get_hex(F.lit("00ff")).alias("c"), V.get_hex(F.lit("FFFFFFFF")).alias("d")).first()
    assert tuple(r) == ("EF12", "00000007", 255, 0xFFFFFFFF)
