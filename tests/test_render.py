"""Rendered slices against pandas and the json module."""

import datetime as dt
import json

import pandas as pd
from pyspark.sql import functions as F

from tablemill.plans.serialize import prepare, serialize
from tablemill.sources.corpus import corpus_from_tables


def frame(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    corpus = corpus_from_tables(df, F.lit("t"), F.lit(1), df.columns[1:], row_key=[df.columns[0]])
    p = prepare(corpus)
    texts = {r.format: r.text for r in serialize(p).collect()}
    from tablemill.operators.order import shuffle_rows

    order = [r.cells for r in shuffle_rows(p.corpus.rows, None, True).orderBy("ord").collect()]
    return texts, order


def test_times_print_by_column(spark):
    day, second = dt.datetime(2020, 5, 1), dt.datetime(2020, 5, 1, 1, 2, 3)
    milli, micro = second.replace(microsecond=5000), second.replace(microsecond=5)
    for values in ([day, day], [day, second], [day, milli], [milli, micro], [day, None]):
        rows = [(i, v, "x") for i, v in enumerate(values)]
        texts, order = frame(spark, rows, "id int, t timestamp_ntz, s string")
        parsed = pd.DataFrame({"t": pd.to_datetime([c[0] for c in order], format="ISO8601"), "s": [c[1] for c in order]})
        assert texts["csv"] == parsed.to_csv(index=False).rstrip("\n")


def test_lone_column(spark):
    texts, order = frame(spark, [(1, "a"), (2, None), (3, "b,c")], "id int, s string")
    assert texts["csv"] == pd.DataFrame({"s": [c[0] for c in order]}).to_csv(index=False).rstrip("\n")
    assert texts["sql_schema"].endswith("\n")


def test_json_and_gaps(spark):
    rows = [(1, 5, 'q"é', True, 1.5), (2, None, None, None, None), (3, 2**53, "\t", False, float("inf"))]
    texts, order = frame(spark, rows, "id int, n bigint, s string, b boolean, f double")
    by_n = {1: rows[0], 2: rows[1], 3: rows[2]}
    records = []
    for cells in order:
        s = cells[1]
        row = next(r for r in rows if r[2] == s)
        n = float("nan") if row[1] is None else float(row[1])
        f = float("nan") if row[4] is None else row[4]
        records.append({"n": n, "s": s, "b": row[3], "f": f})
    assert len(by_n) == 3
    assert texts["json"] == json.dumps(records)


def markdown(spark, rows, schema):
    """Markdown of a whole table in its rows' order, and each row's own."""
    from tablemill.operators.render import display_cells, markdown_row, markdown_table, prepare_columns

    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, " + schema)
    p = prepare(corpus_from_tables(df, F.lit("t"), F.lit(1), df.columns[1:], row_key=["id"]))
    cells = p.corpus.rows.withColumn("at", F.regexp_extract("row_tag", "[0-9]+", 0).cast("int"))
    shown = cells.join(prepare_columns(p.tables).select("table_id", "columns"), "table_id").withColumn(
        "cells", display_cells(F.col("cells"), F.col("columns"))
    )
    found = shown.groupBy("columns").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "cells"))), lambda s: s["cells"]).alias("rows"))
    own = [r.own for r in shown.orderBy("at").select(markdown_row(F.col("cells"), F.col("columns")).alias("own")).collect()]
    return found.select(markdown_table(F.col("rows"), F.col("columns"))).first()[0], own


def test_markdown(spark):
    text, own = markdown(spark, [(1, "long text"), (200, None)], "n int, s string")
    assert text == "|   n | s         |\n|----:|:----------|\n|   1 | long text |\n| 200 |           |"
    assert own == ["|   1 | long text |", "| 200 |     |"]


def test_markdown_numbers_align_at_their_points(spark):
    rows = [(1.5, 1, "7"), (1234567.0, 2, "1e3"), (0.00001, None, " 2.25 "), (float("inf"), 3, None), (100.0, 4, "nan"), (None, 5, "True")]
    text, _ = markdown(spark, rows, "f double, n int, s string")
    assert text.split("\n") == [
        "|             f |   n |       s |",
        "|--------------:|----:|--------:|",
        "|   1.5         |   1 |    7    |",
        "|   1.23457e+06 |   2 | 1000    |",
        # Three characters follow the e, nine the point of the longest.
        "|   1e-05       | nan |    2.25 |",
        "| inf           |   3 |         |",
        "| 100           |   4 |  nan    |",
        "| nan           |   5 | True    |",
    ]


def test_markdown_types_of_text(spark):
    rows = [("007", "1e999", "True", "a|b", "1_0"), (" 5", "1", "False", "  x  ", "2"), (None, "2", None, "", None)]
    text, own = markdown(spark, rows, "w string, t string, b string, p string, u string")
    assert text.split("\n") == [
        "|   w | t     | b     | p   |   u |",
        "|----:|:------|:------|:----|----:|",
        "| 007 | 1e999 | True  | a|b | 1_0 |",
        "|   5 | 1     | False | x   |   2 |",
        "|     | 2     |       |     |     |",
    ]
    # Alone, a row has types of its own.
    assert own[1] == "|   5 |   1 | False | x   |   2 |"


def test_markdown_lines_in_cells(spark):
    rows = [("a\nbcdef\r\ng", 1, "x"), ("h", 2, "y\n\nz"), (None, 3, "\nw\n")]
    text, own = markdown(spark, rows, "s string, n int, t string")
    assert text.split("\n") == [
        "| s     |   n | t   |",
        "|:------|----:|:----|",
        "| a     |   1 | x   |",
        "| bcdef |     |     |",
        "| g     |     |     |",
        "| h     |   2 | y   |",
        "|       |     |     |",
        "|       |     | z   |",
        "|       |   3 | w   |",
    ]
    assert own[1] == "| h   |   2 | y   |\n|     |     |     |\n|     |     | z   |"


def test_whole_numbers_beside_floats_only(spark):
    text, _ = markdown(spark, [(1234567, 0.5), (2, 1.25)], "n bigint, f double")
    assert text.split("\n")[2:] == ["| 1.23457e+06 | 0.5  |", "| 2           | 1.25 |"]


def test_floats_print_with_six_digits(spark):
    values = [0.0, -0.0, 12345.6, 123456.7, -1234.56, 0.00012, 0.000012, 1000000.0, 10.5, 100.0, 999999.9]
    text, _ = markdown(spark, [(v, "x") for v in values], "f double, s string")
    assert [line.split("|")[1].strip() for line in text.split("\n")[2:]] == [f"{v:g}" for v in values]


def test_six_digits(spark):
    import random

    from tablemill.functions.text import six_digits, three_digits

    pick = random.Random(5)
    values = [0.0, -0.0, 1e-4, 9.9999995e-5, 999999.5, 999998.5, 1234565.0, 1234575.0, 0.0078125, 2.5, 1e22, 2.2250738585072014e-308, 1.7976931348623157e308]
    values += [pick.uniform(-1, 1) * 10 ** pick.randint(-12, 20) for _ in range(3000)] + [pick.randint(0, 10**8) / 2 ** pick.randint(0, 12) for _ in range(3000)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", six_digits(F.col("v")).alias("six"), three_digits(F.col("v")).alias("three")).collect()
    assert [(r.six, r.three) for r in rows] == [(f"{r.v:g}", f"{r.v:.3g}") for r in rows]


def test_copies_keep_their_number(spark):
    df = spark.createDataFrame([("a",)] * 25 + [("b",)] * 3, "v string").withColumn("w", F.col("v"))
    p = prepare(corpus_from_tables(df, F.lit("t"), F.lit(1)))
    from tablemill.operators.order import shuffle_rows

    rows = shuffle_rows(p.corpus.rows, None, False).collect()
    assert sorted(r.ord for r in rows) == list(range(28))
    assert sum(r.cells[0] == "a" for r in rows) == 25
