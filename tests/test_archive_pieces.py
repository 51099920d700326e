"""Members in pieces: several tasks for one member, and whole members or none."""

import datetime as dt
import decimal
import io
import zipfile

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tablemill.sources import archives
from tablemill.sources.archives import list_archives, read_archives, read_table_archives


def grouped(table, rows, **options):
    sink = io.BytesIO()
    pq.write_table(table, sink, row_group_size=rows, **options)
    return sink.getvalue()


def pack(path, members, compression=zipfile.ZIP_STORED):
    with zipfile.ZipFile(path, "w", compression) as z:
        for name, raw in members.items():
            z.writestr(name, raw)


@pytest.mark.parametrize("compression", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
def test_a_member_is_the_work_of_several_tasks(spark, tmp_path, compression):
    n = 20_000
    table = pa.table({"n": pa.array(range(n)), "t": pa.array([f"é{i % 7}" for i in range(n)])})
    pack(tmp_path / "chunk-0001.zip", {"big.parquet": grouped(table, n // 20), "a/small.parquet": grouped(table.slice(0, 3), 3)}, compression)
    listed = archives.member_pieces(spark, list_archives(str(tmp_path)), 1)
    assert listed.where("member = 'big.parquet'").count() == 20
    assert [r.columns is None for r in listed.where("member = 'big.parquet'").orderBy("piece").collect()] == [False] + [True] * 19
    spread = archives.decode_pieces(listed.repartition(8, "path", "member", "piece")).withColumn("task", F.spark_partition_id())
    assert spread.where("member = 'big.parquet'").select("task").distinct().count() > 3
    found = read_archives(spark, list_archives(str(tmp_path)), 1)
    rows = found.corpus.rows.where("table_id = 'chunk0001__big.parquet'").orderBy("row_pos").collect()
    assert [r.cells for r in rows] == [[str(i), f"é{i % 7}"] for i in range(n)] and [r.row_pos for r in rows] == list(range(n))
    assert found.errors.count() == 0 and found.corpus.tables.count() == 2


def test_a_value_that_can_not_be_printed_refuses_the_member(spark, tmp_path):
    n = 40_000
    late = pa.array([0] * (n - 1) + [10**18], pa.int64()).cast(pa.timestamp("us"))
    pack(
        tmp_path / "chunk-0001.zip",
        {"late.parquet": grouped(pa.table({"t": late}), n), "pieces.parquet": grouped(pa.table({"t": late}), 1_000), "good.parquet": grouped(pa.table({"t": late.slice(0, 5)}), 2)},
    )
    for size in (1, archives.BYTES_PER_PIECE):
        found = read_archives(spark, list_archives(str(tmp_path)), size)
        assert {r.table_id for r in found.corpus.rows.select("table_id").distinct().collect()} == {"chunk0001__good.parquet"}
        assert [r.table_id for r in found.corpus.tables.collect()] == ["chunk0001__good.parquet"]
        assert sorted(r.member for r in found.errors.collect()) == ["late.parquet", "pieces.parquet"]


@pytest.mark.parametrize("group", [0, 7, 19])
def test_a_fault_in_any_group_refuses_the_member(spark, tmp_path, group):
    n = 20_000
    table = pa.table({"n": pa.array(np.arange(n) * 7919 % 10_007), "t": pa.array([f"{i}" for i in range(n)])})
    raw = bytearray(grouped(table, n // 20, compression="none", use_dictionary=False))
    at = pq.ParquetFile(io.BytesIO(bytes(raw))).metadata.row_group(group).column(0).data_page_offset
    raw[at : at + 40] = b"\xff" * 40
    pack(tmp_path / "chunk-0003.zip", {"broken.parquet": bytes(raw), "whole.parquet": grouped(table, n)})
    found = read_archives(spark, list_archives(str(tmp_path)), 1)
    assert found.corpus.rows.select("table_id").distinct().collect() == [("chunk0003__whole.parquet",)]
    assert found.corpus.rows.count() == n
    assert [(r.chunk, r.member) for r in found.errors.collect()] == [(3, "broken.parquet")]


def test_nothing_to_read(spark, tmp_path):
    found = read_table_archives(spark, str(tmp_path / "nowhere"))
    assert found.corpus.rows.count() == found.corpus.tables.count() == found.errors.count() == 0


def test_every_kind_of_value_is_printed_as_by_a_data_frame(spark, tmp_path):
    table = pa.table(
        {
            "i": pa.array([1, 2, 3]),
            "day": pa.array([dt.date(2000, 1, 1), None, dt.date(1, 2, 3)]),
            "dec": pa.array([decimal.Decimal("1.10"), None, decimal.Decimal("-0.00")], pa.decimal128(5, 2)),
            "ints": pa.array([[1, 2], None, []], pa.list_(pa.int64())),
            "floats": pa.array([[0.1, 1e-9], [float("nan")], None], pa.list_(pa.float64())),
            "texts": pa.array([["a", None], ["é'"], None]),
            "nested": pa.array([[[1], [2, 3]], None, [None]], pa.list_(pa.list_(pa.int32()))),
            "struct": pa.array([{"a": 1, "b": ["x"]}, None, {"a": None, "b": None}], pa.struct([("a", pa.int64()), ("b", pa.list_(pa.string()))])),
            "map": pa.array([[("k", 1), ("l", None)], None, []], pa.map_(pa.string(), pa.int64())),
            "decs": pa.array([[decimal.Decimal("1.5")], None, []], pa.list_(pa.decimal128(5, 1))),
            "days": pa.array([[dt.date(2000, 1, 1)], None, []], pa.list_(pa.date32())),
            "clock": pa.array([dt.time(1, 2, 3), None, dt.time(0, 0)], pa.time64("us")),
            "raw": pa.array([b"ab", None, b"\x00"], pa.binary()),
        }
    )
    pack(tmp_path / "chunk-0001.zip", {"t.parquet": grouped(table, 2)})
    found = read_table_archives(spark, str(tmp_path)).corpus
    rows = [r.cells for r in found.rows.orderBy("row_pos").collect()]
    frame = table.to_pandas()

    def printed(v):
        return None if v is None or (not isinstance(v, (list, dict, np.ndarray)) and pd.isna(v)) else str(v)

    assert rows == [[printed(v) for v in row] for row in frame.itertuples(index=False)]
