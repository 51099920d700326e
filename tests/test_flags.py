"""Profiles from masks of cells equal those from printed cells."""

from __future__ import annotations

import datetime as dt
import decimal

import pytest
from pyspark.sql import functions as F

from tablemill.operators import clean
from tablemill.sources import corpus as sources
from tablemill.sources.corpus import corpus_from_tables

KINDS = (
    "m string, i int, gap bigint, x double, y float, s string, long string, e string, flag boolean, at timestamp_ntz, d date, n decimal(10,2), "
    "l array<int>, wide array<string>, `index` int"
)


def _rows():
    for i in range(24):
        gap, nan = None if i % 3 == 0 else i, float("nan") if i % 4 == 0 else i / 2
        yield (
            ["a/b", "a__b", "c", None][i % 4], i, gap, nan, nan, "s" if i % 5 else None, "t" * (500 + (i == 2)), None, i % 2 == 0 if i % 4 != 2 else None,
            dt.datetime(2024, 1, 1), dt.date(2024, 1, 1), decimal.Decimal("1.50"), [i], ["w" * 600] if i == 5 else None, i,
        )


@pytest.mark.parametrize("row_key", [["i"], None])
def test_masks_tell_what_cells_tell(spark, row_key):
    df = spark.createDataFrame(list(_rows()), KINDS)
    names = df.columns[1:]
    corpus = corpus_from_tables(df, F.col("m"), F.lit(7), names, row_key)
    assert corpus.flags is not None
    told = clean.clean_tables(corpus)
    printed = clean.clean_tables(corpus._replace(flags=None)).select(told.columns)
    assert told.schema.simpleString() == printed.schema.simpleString()
    key = lambda r: (r.table_id, r.member)
    assert sorted(told.collect(), key=key) == sorted(printed.collect(), key=key) != []


def test_profiling_prints_no_plain_cell(spark, monkeypatch):
    monkeypatch.setattr(sources, "cell_text", lambda value, kind: F.raise_error(F.lit("printed")).cast("string"))
    monkeypatch.setattr(sources, "float_text", lambda *_, **__: F.raise_error(F.lit("printed")).cast("string"))
    monkeypatch.setattr(sources, "is_common", lambda _: F.lit(False))
    df = spark.range(20).select("id", (F.col("id") * 1.5).alias("x"), F.lit("words").alias("s"))
    found = clean.clean_tables(corpus_from_tables(df, F.lit("t"), F.lit(1), row_key=["id"])).collect()
    assert [(r.n_rows, [c.kind for c in r["columns"]]) for r in found] == [(20, ["int", "float", "object"])]
