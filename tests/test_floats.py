"""Texts of doubles against Python's own, over random bit patterns, whole numbers, subnormals and powers."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from tablemill.functions.text import float_text


def doubles(rng, kind):
    if kind == "bits":
        return [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(200_000)]
    if kind == "subnormal":
        small = [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(rng.randrange(1, 53))))[0] for _ in range(50_000)]
        return [*small, *[-v for v in small[:1000]], 5e-324, -5e-324, 1e-323, 2.2250738585072014e-308, 2.225073858507201e-308]
    if kind == "whole":
        return [float(rng.getrandbits(rng.randrange(50, 127))) for _ in range(60_000)] + [-(10 ** rng.uniform(15.5, 39)) for _ in range(60_000)]
    powers = [10.0**k for k in range(-323, 309)] + [2.0**k for k in range(-1074, 1024)] + [-(2.0**k) for k in range(-1074, 1024)]
    return [*powers, 1e23, 2e23, 9007199254740993.0, 1.7976931348623157e308, 0.1 + 0.2, 0.0, -0.0, float("inf"), float("-inf")]


@pytest.mark.parametrize("kind", ["bits", "subnormal", "whole", "powers"])
def test_doubles_print_as_in_python(spark, kind):
    values = [v for v in doubles(random.Random(11), kind) if v == v]
    found = spark.createDataFrame([(v,) for v in values], "v double").select("v", float_text(F.col("v"), every=True).alias("t")).collect()
    assert [(r["v"], r["t"]) for r in found if r["t"] != repr(r["v"])] == []
    assert len(found) == len(values)
