"""Files and tasks are as many as folders and bytes ask for, not as tasks times chunks."""

from __future__ import annotations

import io
import random
import zipfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tablemill.plans import ingest
from tablemill.sources import archives, files
from tablemill.sources.archives import list_archives


def member(n):
    sink = io.BytesIO()
    pq.write_table(pa.table({"n": pa.array(range(n))}), sink)
    return sink.getvalue()


def small_archives(folder, n, members):
    for chunk in range(n):
        with zipfile.ZipFile(folder / f"chunk-{chunk:04d}.zip", "w") as z:
            for m in range(members):
                z.writestr(f"m{m}.parquet", member(2))


def test_a_chunk_of_a_format_is_one_file(spark, tmp_path):
    rows = [(f, f"chunk{i % 3:04d}__t{i}", f"{f} {i}") for i in range(90) for f in ("csv", "json")]
    segments = spark.createDataFrame(rows, "format string, table_id string, text string").repartition(8, "table_id")
    files.write_segments(segments, str(tmp_path / "segments"))
    assert len(list(tmp_path.glob("segments/*/*/part-*.json"))) == 6
    found = spark.read.schema("text string, format string, chunk int").json(str(tmp_path / "segments"))
    assert sorted(map(tuple, found.collect())) == sorted((text, f, int(t[5:9])) for f, t, text in rows)
    cells = segments.select(F.substring("table_id", 6, 4).cast("int").alias("chunk"), "table_id", "text")
    files.write_clean_tables(cells, str(tmp_path / "clean"))
    assert len(list(tmp_path.glob("clean/*/part-*.parquet"))) == 3
    assert spark.read.parquet(str(tmp_path / "clean")).count() == len(rows)


def test_a_large_chunk_is_the_work_of_several_tasks(spark, tmp_path):
    draw = random.Random(1)
    rows = [("csv", f"chunk0001__t{i}", draw.randbytes(2000).hex()) for i in range(400)]
    segments = spark.createDataFrame(rows, "format string, table_id string, text string").repartition(8, "table_id")
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(name, "100k")
    try:
        files.write_segments(segments, str(tmp_path))
    finally:
        spark.conf.unset(name)
    assert len(list(tmp_path.glob("*/*/part-*.json"))) > 3
    assert sorted(r.text for r in spark.read.json(str(tmp_path)).collect()) == sorted(r[2] for r in rows)


def test_small_archives_share_tasks(spark, tmp_path, monkeypatch):
    most = 4 * spark.sparkContext.defaultParallelism
    small_archives(tmp_path, most + 3, 1)
    listed = archives.member_pieces(spark, list_archives(str(tmp_path)))
    assert listed.rdd.getNumPartitions() <= most
    assert listed.select("path").distinct().count() == listed.count() == most + 3
    # Bytes ask for tasks of their own.
    monkeypatch.setattr(archives, "BYTES_PER_TASK", 10)
    assert archives.member_pieces(spark, list_archives(str(tmp_path))).rdd.getNumPartitions() > most


@pytest.mark.parametrize("per_batch", [1, 12])
def test_a_drop_leaves_a_file_per_chunk_and_format(spark, tmp_path, per_batch):
    drop, out = tmp_path / "drop", tmp_path / "out"
    drop.mkdir()
    small_archives(drop, 2 if per_batch == 1 else 12, 8)
    ingest.serialize_landed(spark, str(drop), str(out), per_batch=per_batch).awaitTermination(300)
    written = list(out.glob("segments/*/*/*/part-*.json"))
    assert written and len(written) == len({p.parent for p in written})
    assert ingest.read_landed(spark, str(out)).segments.count() == 5 * 8 * (2 if per_batch == 1 else 12)
