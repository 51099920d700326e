"""Costs of plain rows are added up from their cells; all others are rendered."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tablemill.functions import costs
from tablemill.functions.text import float_text, is_common
from tablemill.functions.tokens import count_words
from tablemill.operators import pack
from tablemill.plans.serialize import prepare
from tablemill.sources.corpus import corpus_from_tables

TEXTS = [
    "plain", "two words", " lead", "trail ", "a  b", "a,b", ", ", 'say "x"', "", " ", None, "tab\there", "line\nbreak", "1_000", " 12 ",
    "wide space", "\x01", "a\x01b", "\x7f", "back\\slash", "True", "nan", "x 00:00:00", "\x85", "1e5",
]


def _prepared(spark, days: bool = True):
    midnight = dt.datetime(2024, 1, 2)
    rows = [
        (i, i if i % 4 else None, (i - 3) * 1234567.891 if i % 5 else float("inf"), text, midnight + dt.timedelta(hours=i % 2), i % 3 == 0)
        for i, text in enumerate(TEXTS * 2)
    ]
    df = spark.createDataFrame(rows, "id bigint, gap int, x double, `na me` string, at timestamp_ntz, flag boolean")
    return prepare(corpus_from_tables(df, F.concat(F.lit("t"), (F.col("id") % 3).cast("string")), F.lit(1), row_key=["id"]))


def test_plain_rows_cost_what_their_text_costs(spark):
    p = _prepared(spark)
    summed = {(r.table_id, r.ord): r.costs for r in pack.costed_rows(*p).collect()}
    rendered = {(r.table_id, r.ord): r.costs for r in pack.costed_rows(*p, lambda text: count_words(text)).collect()}
    assert summed == rendered and len(summed) == 2 * len(TEXTS)


def test_plain_rows_are_not_rendered(spark, monkeypatch):
    failing = F.raise_error(F.lit("rendered")).cast("string")
    monkeypatch.setattr(costs, "_row_texts", lambda: dict.fromkeys(["csv", "json", "keyvalue", "markdown"], failing))
    df = spark.range(20).select(F.col("id"), (F.col("id") * 1.5).alias("x"), F.lit("some words").alias("s"))
    p = prepare(corpus_from_tables(df, F.lit("t"), F.lit(1), row_key=["id"]))
    assert {tuple(r.costs) for r in pack.costed_rows(*p).collect()} == {(2, 6, 13, 8, 2)}


def test_common_numbers_print_like_all(spark):
    values = [0.0, -0.0, 1e-3, 9.99e-4, 9999999.5, 1e7, 123.25, -5.0, 1e16, float("inf"), None, 5e-324]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    made = df.select(F.when(is_common(F.col("v")), F.col("v").cast("string")).otherwise(float_text(F.col("v"), every=True)).alias("a"),
                     float_text(F.col("v"), every=True).alias("b")).collect()
    assert all(r.a == r.b for r in made)


def test_rows_with_quotes_and_gaps_are_not_rendered(spark, monkeypatch):
    df = spark.sql("""SELECT id, if(id % 2 = 0, null, id) AS gap, if(id % 3 = 0, null, '{"k": 1, "l": "x"}') AS s,
        if(id % 4 = 0, null, timestamp_ntz'2024-01-01 01:00:00') AS at, if(id % 5 = 0, null, id % 2 = 0) AS flag FROM range(60)""")
    p = prepare(corpus_from_tables(df, F.lit("t"), F.lit(1), row_key=["id"]))
    rendered = {r.ord: r.costs for r in pack.costed_rows(*p, lambda text: count_words(text)).collect()}
    failing = F.raise_error(F.lit("rendered")).cast("string")
    monkeypatch.setattr(costs, "_row_texts", lambda: dict.fromkeys(["csv", "json", "keyvalue", "markdown"], failing))
    assert {r.ord: r.costs for r in pack.costed_rows(*p).collect()} == rendered


def test_headers_of_plain_tables_are_known(spark):
    df = spark.range(6).select("id", F.lit("x").alias("a b"), F.lit("y").alias("line\nbreak"), (F.col("id") / 7).alias('q"u, o'), F.lit("z").alias(" "))
    p = prepare(corpus_from_tables(df, F.concat(F.lit("t"), F.col("id").cast("string")), F.lit(1), row_key=["id"]))
    known = {r.table_id: r.heads for r in pack.costed_rows(*p).collect()}
    assert known == {r.table_id: r.header_costs for r in pack.table_headers(p.corpus, p.tables).collect()}
