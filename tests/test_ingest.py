"""Drops of archives as a stream: each once, also when a batch is run again."""

import io
import shutil
import zipfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tablemill.plans import ingest
from tablemill.plans.serialize import prepare, serialize
from tablemill.sources import commits
from tablemill.sources.archives import read_table_archives


def archive(path, chunk, members, broken=False):
    with zipfile.ZipFile(path / f"chunk-{chunk:04d}.zip", "w") as z:
        for m in range(members):
            sink = io.BytesIO()
            pq.write_table(pa.table({"n": pa.array(range(m + 2)), "t": pa.array([f"{chunk} {m} {i}" for i in range(m + 2)])}), sink)
            z.writestr(f"m{m}.parquet", sink.getvalue())
        if broken:
            z.writestr("bad.parquet", b"nothing")


def run(spark, folder, out, **options):
    ingest.serialize_landed(spark, str(folder), str(out), budget=8, **options).awaitTermination(300)


def test_two_drops_once_each(spark, tmp_path):
    drop, out = tmp_path / "drop", tmp_path / "out"
    drop.mkdir()
    (drop / "notes.txt").write_text("no archive")
    archive(drop, 7, 2, broken=True)
    archive(drop, 9, 1)
    run(spark, drop, out, per_batch=1)
    found = ingest.read_landed(spark, str(out))
    assert sorted((r.table_id, r.n_rows) for r in found.tables.collect()) == [
        ("chunk0007__m0.parquet", 2), ("chunk0007__m1.parquet", 3), ("chunk0009__m0.parquet", 2)
    ]
    assert found.tables.select("batch").distinct().count() == 2
    assert [r.table_id for r in found.errors.collect()] == ["chunk0007__bad.parquet"]
    # An archive of a smaller number lands later; a run without news does nothing.
    archive(drop, 3, 3)
    (drop / "chunk-0004.zip").write_bytes(b"no archive")
    run(spark, drop, out)
    run(spark, drop, out)
    found = ingest.read_landed(spark, str(out))
    assert found.tables.count() == found.tables.select("table_id").distinct().count() == 6
    assert sorted(r.chunk for r in found.errors.collect()) == [4, 7]
    whole = serialize(prepare(read_table_archives(spark, str(drop)).corpus), 8)
    assert sorted(map(tuple, found.segments.select("format", "text").collect())) == sorted(map(tuple, whole.select("format", "text").collect()))


def test_a_batch_that_is_run_again_adds_nothing(spark, tmp_path, monkeypatch):
    drop, out = tmp_path / "drop", tmp_path / "out"
    drop.mkdir()
    archive(drop, 1, 2)
    with monkeypatch.context() as broken:
        broken.setattr(commits, "commit", lambda *_: (_ for _ in ()).throw(OSError("stopped")))
        with pytest.raises(Exception, match="stopped"):
            run(spark, drop, out)
    assert ingest.read_landed(spark, str(out)).segments.count() == 0
    run(spark, drop, out)
    first = ingest.read_landed(spark, str(out))
    lines = sorted(map(tuple, first.segments.select("format", "text").collect()))
    assert lines and first.tables.count() == 2
    # The stream forgets that it finished the batch: it is handed out again, and was committed.
    shutil.copytree(out / "_stream", tmp_path / "kept", dirs_exist_ok=True)
    batch = spark.createDataFrame([(str(drop / "chunk-0001.zip"), 1)], "path string, length bigint")
    ingest.ingest(batch, 0, str(out), budget=8)
    again = ingest.read_landed(spark, str(out))
    assert sorted(map(tuple, again.segments.select("format", "text").collect())) == lines and again.tables.count() == 2


def test_chosen_chunks_only(spark, tmp_path):
    drop, out = tmp_path / "drop", tmp_path / "out"
    drop.mkdir()
    archive(drop, 24, 1)
    archive(drop, 25, 1)
    run(spark, drop, out, chunks=[25])
    assert [r.table_id for r in ingest.read_landed(spark, str(out)).tables.collect()] == ["chunk0025__m0.parquet"]
