import json
import random
import struct

from pyspark.sql import functions as F

from tablemill.functions import text as X
from tablemill.functions.tokens import count_words


def test_float_text(spark):
    rng = random.Random(1)
    values = [0.0, -0.0, 1e-5, 1e-4, 1e15, 1e16, 1e22, 1e23, 2e23, 0.1 + 0.2, 100.0, 12345678.9,
              float("inf"), float("-inf"), 123456789012345.6, 2.0**53 + 2, 1.7e308]
    values += [rng.uniform(-1e6, 1e6) for _ in range(3000)]
    values += [rng.uniform(0.1, 10) * 10 ** rng.randint(-300, 300) for _ in range(3000)]
    values += [round(rng.uniform(0, 1e9), 2) for _ in range(3000)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", X.float_text(F.col("v"))).collect()
    wrong = [(v, t) for v, t in rows if repr(v) != t]
    assert not wrong, wrong[:10]


def test_single_precision(spark):
    import numpy as np

    values = [1.1, 0.5, 1e-5, 3.4e38, 16777216.0, 1e10]
    rows = spark.createDataFrame([(v,) for v in values], "v float").select("v", X.float_text(F.col("v"), single=True)).collect()
    assert [t for _, t in rows] == [str(np.float32(v)) for v in values]


def test_three_digits(spark):
    rng = random.Random(2)
    values = [0.0, -0.0, 12.0, 2.675, 12350.0, 12250.0, 0.125, 999.5, 9995.0, 1e-5, 0.00012345, 100.0, 1e300,
              float("inf"), -1234.5, 0.1 + 0.2]
    values += [rng.uniform(-1e5, 1e5) for _ in range(2000)]
    values += [rng.randint(1000, 9999) / 10 ** rng.randint(0, 9) for _ in range(4000)]
    values += [float(rng.randint(100, 999) * 100 + 50) for _ in range(500)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", X.three_digits(F.col("v"))).collect()
    wrong = [(v, t, f"{v:.3g}") for v, t in rows if f"{v:.3g}" != t]
    assert not wrong, wrong[:10]


def test_json_escape(spark):
    values = ["plain", 'q"b\\', "tab\tnl\ncr\r\b\f", "é漢", "😀", "\x7f\x01", "", "a/b", " "]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", X.json_string(F.col("v"))).collect()
    assert [t for _, t in rows] == [json.dumps(v) for v in values]


def test_words(spark):
    values = ["a b", " a b　c ", "", "x\ny\tz", "a\x1cb\x85c", "​q"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", count_words(F.col("v"))).collect()
    assert [n for _, n in rows] == [len(v.split()) for v in values]


def test_csv_quote(spark):
    values = ["a", "a,b", 'a"b', "a\nb", " a", "a\rb"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(X.csv_quote(F.col("v"))).collect()
    assert [r[0] for r in rows] == ["a", '"a,b"', '"a""b"', '"a\nb"', " a", '"a\rb"']
