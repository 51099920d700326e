"""Ranges of tables of one width travel as one row per table, and are those of any width."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablemill.operators.render import column_ranges
from tablemill.plans.serialize import prepare
from tablemill.sources.corpus import corpus_from_tables


def test_ranges_of_one_width(spark):
    rows = [(i % 3, (1 << 62) + i, i * 1.5 if i % 4 else None, "t") for i in range(30)] + [(5, None, float("inf"), None)]
    df = spark.createDataFrame(rows, "t int, n bigint, x double, s string")
    p = prepare(corpus_from_tables(df, F.col("t").cast("string"), F.lit(1)))
    wide = column_ranges(p.corpus.rows, p.tables)
    narrow = column_ranges(p.corpus.plain, p.tables, p.corpus.width)
    assert narrow.columns == wide.columns
    assert sorted(map(str, narrow.collect())) == sorted(map(str, wide.collect())) != []
    # Cells aren't dealt out one by one before they are reduced.
    assert "posexplode(cells" not in narrow._jdf.queryExecution().optimizedPlan().toString()
