"""Rows without a key are ordered after one shuffle, copies included."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablemill.operators import order
from tablemill.sources import corpus as sources
from tablemill.sources.corpus import corpus_from_tables


def _corpus(spark):
    rows = [(f"t{i % 3}", i % 5, "w" * 600 if i % 7 == 0 else "w", None if i % 2 else 1.5) for i in range(300)]
    df = spark.createDataFrame(rows, "m string, a int, s string, x double")
    return corpus_from_tables(df, F.col("m"), F.lit(1), ["a", "s", "x"])


def test_order_with_copies_is_the_same(spark, monkeypatch):
    monkeypatch.setattr(sources, "COPIES_PER_RUN", 4)
    monkeypatch.setattr(order, "COPIES_PER_RUN", 4)
    c = _corpus(spark)
    for shorten in (False, True):
        counted = order.order_rows(c.rows, None, False, shorten)
        numbered = order.order_rows(c.rows, None, False, shorten, c.plain)
        key = lambda r: (r.table_id, r.ord)
        assert sorted(numbered.collect(), key=key) == sorted(counted.collect(), key=key)
        assert numbered.count() == 300


def test_rows_move_once(spark):
    c = _corpus(spark)
    plan = order.shuffle_rows(c.rows, None, c.unique, c.plain)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
