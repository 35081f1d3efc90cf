"""Number text against Python's shortest repr and exact decimals."""

import random
import struct
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from tickvet.functions.numbers import fixed, fixed_text, number_text


def shortest(x: float) -> str:
    if x != x or x in (float("inf"), float("-inf")):
        return {"nan": "NaN", "inf": "Infinity", "-inf": "-Infinity"}[repr(x)]
    sign, digits, exponent = Decimal(repr(abs(x))).as_tuple()
    digits = "".join(map(str, digits))
    kept = digits.rstrip("0")
    k = len(digits) + exponent
    m, minus = len(kept), "-" if x < 0 else ""
    if not kept:
        return "0"
    if m <= k <= 21:
        return minus + kept + "0" * (k - m)
    if 0 < k <= 21:
        return f"{minus}{kept[:k]}.{kept[k:]}"
    if -6 < k <= 0:
        return f"{minus}0.{'0' * -k}{kept}"
    return f"{minus}{kept[0]}{'.' + kept[1:] if m > 1 else ''}e{'+' if k > 0 else '-'}{abs(k - 1)}"


def numbers() -> list[float]:
    rng = random.Random(5)
    out = [0.0, -0.0, 1.0, 100.0, -2.5, 0.1, 1e-6, 1e-7, 123456.789, 1e21, 1e20, 1.5e300, 2.3e-308, 2e-3, 2.0**-44, 8.41e21, 1.005, 2.675, 1.255, 0.125, 0.375, 2.5, 0.5, 1.5, 9.995, 0.9999999, 999.99999, -0.004, -1.005, 1e15 + 0.5, 2.0**52 + 0.5, 123456789012.345]
    out += [float("nan"), float("inf"), float("-inf")]
    out += [struct.unpack("d", rng.randbytes(8))[0] for _ in range(3000)]
    out += [round(rng.uniform(-1000, 1000), rng.randint(0, 6)) for _ in range(3000)]
    out += [rng.randint(-100000, 100000) / 2 ** rng.randint(0, 12) for _ in range(3000)]  # many exact ties
    out += [(2 * rng.randint(0, 50000) + 1) / 2 / 10 ** rng.randint(1, 5) for _ in range(3000)]  # ties of the decimal text
    return [x for x in out if not 0 < abs(x) < 2.3e-308]


def test_shortest_text(spark):
    xs = numbers()
    got = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i long, x double").select("i", "x", number_text("x").alias("s")).collect()
    assert [(r.x, r.s) for r in got if r.s != shortest(r.x)] == []


def test_rounds_the_binary_value(spark):
    xs = [x for x in numbers() if abs(x) < 1e17]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i long, x double")
    got = df.select("x", *(fixed_text("x", d).alias(f"t{d}") for d in (0, 1, 2, 4, 6, 7)), fixed("x", 2).alias("f2")).collect()
    wrong = []
    for r in got:
        for d in (0, 1, 2, 4, 6, 7):
            want = format(abs(Decimal(r.x)).quantize(Decimal(1).scaleb(-d), ROUND_HALF_UP), "f")
            if r.x < 0 and float(want) != 0:
                want = "-" + want
            if r[f"t{d}"] != want:
                wrong.append((r.x, d, r[f"t{d}"], want))
        assert r.f2 == float(r.t2)
    assert wrong == []


def test_nulls_and_an_empty_table(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert df.select(number_text("x").alias("a"), fixed_text("x", 2).alias("b"), fixed("x", 2).alias("c")).first() == (None, None, None)
    assert df.filter("false").select(number_text("x")).collect() == []
    one = spark.createDataFrame([("1e9", 3)], "s string, d int").select(fixed_text(F.col("s"), F.col("d")).alias("t"), fixed_text(F.lit(2.675), F.col("d")).alias("u")).first()
    assert one == ("1000000000.000", "2.675")
