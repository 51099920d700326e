"""Registered queries against their SQL on the smallest tables.

Runs a part by default; set TABLEMILL_ALL=1 for every query.
"""

import glob
import math
import os

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
FOLDER = os.environ.get("TABLEMILL_DATA", "/root/testdata/sf0.001")
QUICK = """table_ids clean_report csv_row keyvalue_row json_row_escapes segment_text pack_segments
pack_segments_split rows_kept fit_rows tokenize_segments fan_out_pairs pair_type_coverage accuracy_summary
eval_plan format_completeness ema loss_at_budget holdout_leak""".split()
NAMES = list(entry.queries()) if os.environ.get("TABLEMILL_ALL") else QUICK


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return float(value) if type(value).__name__ == "Decimal" else value


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, tables, name):
    found = entry.queries()[name](spark, FOLDER)
    columns = sorted(found.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in found.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    cursor = tables.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    expected = [tuple(plain(r[i]) for i in at) for r in cursor.fetchall()]
    assert sorted(rows, key=repr) == sorted(expected, key=repr)
