"""Queries over files of foreign formats, written from driver tables in pieces of bounded size."""

from __future__ import annotations

import io
import os
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from tablemill.catalog import sql as S
from tablemill.catalog.corpora import NUMBERS, prepared, source
from tablemill.catalog.evaluation import new_folder
from tablemill.catalog.registry import query
from tablemill.catalog.tables import SMALL, with_
from tablemill.constants import FORMATS, INDEX_MAGIC
from tablemill.operators import pack, runs
from tablemill.plans import ingest
from tablemill.plans.serialize import serialize
from tablemill.sources.archives import read_table_archives
from tablemill.sources.files import data_file_sizes, shard_index_stats

ROWS_PER_MEMBER = 100
MEMBERS_PER_ARCHIVE = 10


def local(folder: str) -> str:
    """Foreign formats are written by plain file calls, so the shared folder must be mounted."""
    folder = folder.removeprefix("file:")
    if "://" in folder:
        raise ValueError(f"{folder} is not a mounted folder")
    return "/" + folder.lstrip("/")


def write_archives(customers, folder: str) -> None:
    """Archives of tables of 100 customers each; member 3 of every archive is broken."""

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq

        def save(chunk, members):
            with zipfile.ZipFile(os.path.join(folder, f"chunk-{chunk:04d}.zip"), "w") as out:
                for member, rows in members:
                    buffer = io.BytesIO()
                    pq.write_table(pa.Table.from_pandas(rows, preserve_index=False), buffer)
                    broken = member % MEMBERS_PER_ARCHIVE == 3
                    out.writestr(f"t/{member}=x.parquet", b"broken" if broken else buffer.getvalue())

        held = None
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame])
            last = held["chunk"].iloc[-1]
            for chunk, rows in held[held["chunk"] != last].groupby("chunk"):
                save(chunk, _members(rows))
            held = held[held["chunk"] == last]
        if held is not None:
            save(held["chunk"].iloc[0], _members(held))
        yield pd.DataFrame({"done": pd.Series([], dtype="int64")})

    os.makedirs(folder, exist_ok=True)
    size = ROWS_PER_MEMBER * MEMBERS_PER_ARCHIVE
    numbered = customers.withColumns(
        {
            "chunk": F.expr(f"cast(c_custkey div {size} as int)"),
            "member": F.expr(f"cast(c_custkey div {ROWS_PER_MEMBER} as int)"),
        }
    )
    placed = numbered.repartition("chunk").sortWithinPartitions("chunk", "c_custkey")
    placed.mapInPandas(write, "done bigint").count()


def _members(rows: pd.DataFrame):
    for member, part in rows.groupby("member"):
        yield int(member), part.drop(columns=["chunk", "member"])


ARCHIVED = f"""WITH t AS (SELECT c_custkey // 1000 AS chunk, c_custkey // 100 AS m, * FROM customer),
n AS (SELECT *, 't/' || m || '=x.parquet' AS member, 'chunk' || lpad(chunk::VARCHAR, 4, '0') || '__t__' || m || '=x.parquet' AS table_id FROM t)"""


@query(
    "read_table_archives",
    f"{ARCHIVED} SELECT table_id, {S.seed('member')} AS seed, lpad((c_custkey % 100)::VARCHAR, 15, '0') AS row_tag, "
    "array_to_string([c_custkey::VARCHAR, c_name, c_nationkey::VARCHAR, c_acctbal::VARCHAR, c_mktsegment], '|') AS cells "
    "FROM n WHERE m % 10 <> 3",
)
def archive_rows(spark, sf):
    folder = local(new_folder(spark))
    write_archives(source(spark, sf, "customer"), folder)
    rows = read_table_archives(spark, folder).corpus.rows
    return rows.select("table_id", "seed", "row_tag", F.array_join("cells", "|").alias("cells"))


@query("archive_errors", f"{ARCHIVED} SELECT DISTINCT table_id FROM n WHERE m % 10 = 3")
def archive_errors(spark, sf):
    folder = local(new_folder(spark))
    write_archives(source(spark, sf, "customer"), folder)
    return read_table_archives(spark, folder).errors.select("table_id")


@query(
    "serialize_stats",
    with_(
        f"{S.packed(NUMBERS, SMALL)}, {S.slices('packed')}, tok AS (SELECT table_id, format, {S.tokens('text')} AS n FROM slice_text)",
        "SELECT format, chunk, count(DISTINCT table_id) AS processed, coalesce(sum(n), 0) AS tokens, coalesce(any_value(bad), 0) AS skipped "
        "FROM (SELECT table_id, chunk, f.format FROM tabs, (SELECT DISTINCT format FROM headers) f) LEFT JOIN tok USING (table_id, format) "
        "LEFT JOIN (SELECT CAST(c_custkey // 1000 AS INTEGER) AS chunk, count(DISTINCT c_custkey // 100) AS bad FROM customer "
        "WHERE (c_custkey // 100) % 10 = 3 GROUP BY 1) USING (chunk) GROUP BY format, chunk",
        True,
    ),
)
def stats(spark, sf):
    """Skipped are members that archives of the same chunk numbers hold and that can't be read."""
    folder = local(new_folder(spark))
    write_archives(source(spark, sf, "customer"), folder)
    p = prepared(spark, sf, NUMBERS)
    return pack.serialize_stats(p.tables, serialize(p, SMALL), read_table_archives(spark, folder).errors.select("chunk", "table_id"))


@query(
    "landed_archives",
    f"{ARCHIVED} SELECT table_id, chunk::INTEGER AS chunk, count(*) AS n_rows, (chunk % 2)::INTEGER AS drop_no FROM n WHERE m % 10 <> 3 GROUP BY ALL",
)
def landed(spark, sf):
    """Archives that land in two drops, each serialised once; the second run finds only what is new."""
    folder, out = local(new_folder(spark)), new_folder(spark)
    customers = source(spark, sf, "customer")
    for drop in (0, 1):
        write_archives(customers.where(F.expr("c_custkey div 1000 % 2") == drop), folder)
        ingest.serialize_landed(spark, folder, out, per_batch=1_000_000).awaitTermination()
    found = ingest.read_landed(spark, out)
    # The archives of one drop make one batch, and batches are numbered from 0.
    return found.tables.select("table_id", "chunk", "n_rows", F.col("batch").cast("int").alias("drop_no"))


DOCS_PER_SHARD = 50


def write_index_files(docs, root: str) -> None:
    """One index of text lengths per 50 documents, every seventh unreadable, with data files beside."""

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for (fmt, shard), rows in frame.groupby(["format", "shard"]):
                # A shard's 50 lengths are one array of one row.
                lengths = rows["lengths"].iloc[0]
                folder = os.path.join(root, fmt)
                os.makedirs(folder, exist_ok=True)
                name = os.path.join(folder, f"train_{shard:05d}")
                magic = b"BROKEN!!!" if shard % 7 == 0 else INDEX_MAGIC
                head = magic + struct.pack("<QBQQ", 1, 4, len(lengths), len(lengths))
                with open(name + ".idx", "wb") as out:
                    out.write(head + struct.pack(f"<{len(lengths)}i", *lengths))
                with open(name + ".bin", "wb") as out:
                    out.write(bytes(4 * int(shard) + 3))
            yield pd.DataFrame({"done": pd.Series([], dtype="int64")})

    shards = (
        docs.withColumn("shard", F.expr(f"doc_id div {DOCS_PER_SHARD}"))
        .groupBy("shard")
        .agg(F.collect_list(F.col("n_chars").cast("int")).alias("lengths"))
    )
    names = F.array(*[F.lit(f) for f in FORMATS])
    named = shards.withColumn("format", F.element_at(names, (F.col("shard") % 5 + 1).cast("int")))
    named.mapInPandas(write, "done bigint").count()


@query(
    "shard_index_stats",
    "WITH s AS (SELECT doc_id // 50 AS n, count(*) AS segments, sum(n_chars) AS tokens FROM documents GROUP BY 1) "
    "SELECT CASE n % 5 WHEN 0 THEN 'csv' WHEN 1 THEN 'json' WHEN 2 THEN 'keyvalue' WHEN 3 THEN 'markdown' ELSE 'sql_schema' END AS format, "
    "'train_' || lpad(n::VARCHAR, 5, '0') AS shard, CASE WHEN n % 7 = 0 THEN 0 ELSE segments END AS segments, "
    "CASE WHEN n % 7 = 0 THEN n ELSE tokens END AS tokens FROM s",
)
def index_files(spark, sf):
    root = local(new_folder(spark))
    write_index_files(source(spark, sf, "documents"), root)
    return runs.shard_tokens(shard_index_stats(spark, root), data_file_sizes(spark, root))
