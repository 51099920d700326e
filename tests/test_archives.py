"""Archives with every kind of column, a broken member, a broken archive and an empty table."""

import datetime as dt
import decimal
import io
import zipfile

import pyarrow as pa
import pyarrow.parquet as pq

from tablemill.operators import pack
from tablemill.operators.order import by_position, shuffle_rows
from tablemill.plans.serialize import prepare, serialize
from tablemill.sources.archives import read_table_archives


def parquet(table):
    buffer = io.BytesIO()
    pq.write_table(table, buffer)
    return buffer.getvalue()


def make(folder):
    kinds = pa.table(
        {
            "i8": pa.array([1, 2, None], pa.int8()),
            "u8": pa.array([1, 2, 3], pa.uint8()),
            "f32": pa.array([1.1, float("nan"), float("inf")], pa.float32()),
            "f64": pa.array([1e-5, 1e16, 0.1 + 0.2], pa.float64()),
            "flag": pa.array([True, None, False]),
            "text": pa.array(['a,"b"', "é\n", " "]),
            "when": pa.array([dt.datetime(2000, 1, 1), dt.datetime(2000, 1, 2, 3, 4, 5), None], pa.timestamp("us")),
            "day": pa.array([dt.date(2000, 1, 1), None, dt.date(2001, 1, 1)]),
            "dec": pa.array([decimal.Decimal("1.10"), None, None], pa.decimal128(5, 2)),
            "list": pa.array([[1, 2], None, []], pa.list_(pa.int64())),
            "gone": pa.array([None, None, None], pa.string()),
            "Unnamed: 0": pa.array([1, 2, 3]),
            "long": pa.array(["x" * 501, "y", "z"]),
            "edge": pa.array(["x" * 500, "y", "z"]),
        }
    )
    with zipfile.ZipFile(folder / "chunk-0007.zip", "w") as z:
        z.writestr("d/b=1.parquet", parquet(kinds))
        z.writestr("a.parquet", parquet(pa.table({"n": pa.array([1.5, 2.5]), "k": pa.array([1, 2])})))
        z.writestr("bad.parquet", b"no parquet")
        z.writestr("empty.parquet", parquet(pa.table({"n": pa.array([], pa.int64())})))
        z.writestr("readme.txt", "no table")
    (folder / "chunk-0008.zip").write_bytes(b"no archive")


def test_archives(spark, tmp_path):
    make(tmp_path)
    found = read_table_archives(spark, str(tmp_path))
    errors = {r.table_id for r in found.errors.collect()}
    assert errors == {"chunk0007__bad.parquet", None}
    p = prepare(found.corpus)
    tables = {r.table_id: r for r in p.tables.collect()}
    assert set(tables) == {"chunk0007__a.parquet", "chunk0007__d__b=1.parquet"}
    kinds = {c.name: c.kind for c in tables["chunk0007__d__b=1.parquet"].columns}
    assert kinds == {
        "i8": "int_nullable", "u8": "int", "f32": "single", "f64": "float", "flag": "bool_object",
        "text": "object", "when": "time", "day": "object", "dec": "object", "list": "object", "edge": "object",
    }
    segments = {(r.table_id, r.format): r for r in serialize(p).collect()}
    assert len(segments) == 10
    small = segments["chunk0007__a.parquet", "keyvalue"].text
    assert sorted(small.split("\n")) == ["The n is 1.5. The k is 1.0.", "The n is 2.5. The k is 2.0."]
    sql = segments["chunk0007__a.parquet", "sql_schema"].text
    assert sql.startswith('CREATE TABLE data (\n    "n" FLOAT -- range: 1.5 to 2.5,\n    "k" INT -- range: 1 to 2\n);\nn,k\n')
    assert sql.endswith("\n")
    text = segments["chunk0007__d__b=1.parquet", "json"].text
    assert '"i8": 1.0' in text and '"i8": NaN' in text and '"f32": Infinity' in text
    assert '"when": "NaT"' in text and '"flag": null' in text and '"text": "\\u00e9\\n"' in text
    assert '"f32": 1.100000023841858' in text and '"dec": "1.10"' in text and '"list": "[1 2]"' in text


def test_chunk_choice(spark, tmp_path):
    make(tmp_path)
    assert read_table_archives(spark, str(tmp_path), [24]).corpus.rows.count() == 0


def test_split_tables_pack_the_same(spark, tmp_path):
    make(tmp_path)
    found = read_table_archives(spark, str(tmp_path)).corpus
    whole, cut = prepare(found), prepare(found, split_rows=1)
    assert whole.large is None and cut.large is not None
    key = ["table_id", "format", "seg_no"]
    texts = [
        sorted(map(tuple, serialize(p, 25).select(*key, "start_ord", "end_ord", "text").collect()))
        for p in (whole, cut)
    ]
    assert texts[0] == texts[1]


def test_member_that_breaks_off_is_no_table(spark, tmp_path):
    n = 60_000
    sink = io.BytesIO()
    with pq.ParquetWriter(sink, pa.schema([("n", pa.int64()), ("t", pa.string())]), compression="none") as w:
        for _ in range(2):
            w.write_table(pa.table({"n": pa.array(range(n // 2)), "t": pa.array(["x" * 9] * (n // 2))}), row_group_size=n // 2)
    raw = bytearray(sink.getvalue())
    at = pq.ParquetFile(io.BytesIO(bytes(raw))).metadata.row_group(1).column(0).data_page_offset
    raw[at : at + 2_000] = b"\xff" * 2_000
    with zipfile.ZipFile(tmp_path / "chunk-0001.zip", "w") as z:
        z.writestr("broken.parquet", bytes(raw))
        z.writestr("whole.parquet", parquet(pa.table({"n": pa.array([1, 2])})))
    found = read_table_archives(spark, str(tmp_path))
    assert {r.table_id for r in found.corpus.rows.collect()} == {"chunk0001__whole.parquet"}
    assert [r.member for r in found.corpus.tables.collect()] == ["whole.parquet"]
    assert [r.member for r in found.errors.collect()] == ["broken.parquet"]


def test_rows_keep_their_place(spark, tmp_path):
    values = list(range(40, 0, -1))
    with zipfile.ZipFile(tmp_path / "chunk-0001.zip", "w") as z:
        z.writestr("t.parquet", parquet(pa.table({"n": pa.array(values)})))
    own = by_position(read_table_archives(spark, str(tmp_path)).corpus)
    rows = shuffle_rows(own.rows, None, True).orderBy("ord").collect()
    assert [r.cells for r in rows] == [[str(v)] for v in values]
