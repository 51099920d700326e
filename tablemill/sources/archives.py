"""Archives of Parquet tables: one zip per chunk, one member per table.

Reading is a plan of its own. The archives' members are listed with their footers; each member is cut into
pieces of whole row groups; pieces are decoded wherever there is room, so that a large member is the work of
several tasks. What is decoded is stored once, with a line for every piece that failed, and a member counts only
if none of its pieces did: its rows and its table appear together or not at all, beside one error.
"""

from __future__ import annotations

import math
import os
import re
import zipfile
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablemill.session import stage
from tablemill.sources.corpus import Corpus, table_id, table_seed

ARCHIVE_NAME = r"chunk-(\d+)\.zip$"
#: Bytes of archive whose members one task lists, and of row groups that make a piece.
BYTES_PER_TASK = 128 * 1024 * 1024
BYTES_PER_PIECE = 32 * 1024 * 1024
BATCH_ROWS = 8192

PIECES = (
    "path string, chunk int, member string, columns array<struct<pos: int, name: string, arrow_type: string>>, "
    "piece int, first_group int, n_groups int, first_row bigint, bytes bigint, message string"
)
DECODED = "path string, chunk int, member string, row_no bigint, cells array<string>, message string"


def _store(uri: str):
    """The file system of a folder or file (local, HDFS or an object store) and the path in it."""
    if re.match("file:/[^/]", uri):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri if "://" in uri else os.path.abspath(uri))


class Archive(NamedTuple):
    """A chunk's zip file."""

    path: str
    chunk: int
    size: int


def chunk_number(path: str) -> int | None:
    found = re.search(ARCHIVE_NAME, path)
    return int(found[1]) if found else None


def list_archives(folder: str, chunks: list[int] | None = None) -> list[Archive]:
    """The chunk archives of a folder, by path."""
    store, path = _store(folder)
    listed = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    prefix = folder[: -len(path)] if "://" in folder and folder.endswith(path) else ""
    found = [Archive(prefix + i.path, chunk_number(i.path), i.size) for i in listed if i.is_file and chunk_number(i.path) is not None]
    return sorted(a for a in found if chunks is None or a.chunk in chunks)


def _pieces(file: pq.ParquetFile, most: int) -> list[tuple[int, int, int, int]]:
    """(first row group, row groups, first row, bytes) of pieces of about `most` bytes; one empty piece if there is no row."""
    out, row = [], 0
    for i in range(file.metadata.num_row_groups):
        group = file.metadata.row_group(i)
        if not out or out[-1][3] + group.total_byte_size > most:
            out.append((i, 0, row, 0))
        first, n, at, size = out[-1]
        out[-1] = (first, n + 1, at, size + group.total_byte_size)
        row += group.num_rows
    return out or [(0, 0, 0, 0)]


def member_pieces(spark: SparkSession, archives: list[Archive], piece_bytes: int = BYTES_PER_PIECE) -> DataFrame:
    """One row per piece of every member, from the members' footers, or one with a message per unreadable archive or member."""
    shares = [(a.path, a.chunk, s, n) for a in archives for n in [max(1, math.ceil(a.size / BYTES_PER_TASK))] for s in range(n)]

    def look(path: str, chunk: int, share: int, of: int) -> Iterator[dict]:
        try:
            archive = zipfile.ZipFile(_open(path))
        except (OSError, zipfile.BadZipFile, pa.ArrowInvalid) as e:
            if share == 0:
                yield {"path": path, "chunk": chunk, "message": str(e) or type(e).__name__}
            return
        with archive:
            for member in sorted({n for n in archive.namelist() if n.endswith(".parquet")})[share::of]:
                own = {"path": path, "chunk": chunk, "member": member}
                try:
                    with archive.open(member) as f:
                        file = pq.ParquetFile(f)
                        columns = [{"pos": i, "name": c.name, "arrow_type": str(c.type)} for i, c in enumerate(file.schema_arrow)]
                        found = _pieces(file, piece_bytes)
                except Exception as e:  # noqa: BLE001 - any unreadable member is reported, not fatal
                    yield own | {"message": str(e) or type(e).__name__}
                    continue
                for k, (first, n, row, size) in enumerate(found):
                    place = {"piece": k, "first_group": first, "n_groups": n, "first_row": row, "bytes": size}
                    yield own | place | {"columns": columns if k == 0 else None}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item in batch.to_pylist():
                yield from _batches(look(item["path"], item["chunk"], item["share"], item["of"]), PIECE_TYPE)

    # Small archives share a task: one each would cost more to start than to list, and leave as many files.
    most = max(spark.sparkContext.defaultParallelism * 4, math.ceil(sum(a.size for a in archives) / BYTES_PER_TASK))
    items = spark.createDataFrame(shares, "path string, chunk int, share int, of int")
    return items.coalesce(1).repartition(max(1, min(len(shares), most))).mapInArrow(run, PIECES)


PIECE_TYPE = pa.schema(
    [
        ("path", pa.string()), ("chunk", pa.int32()), ("member", pa.string()),
        ("columns", pa.list_(pa.struct([("pos", pa.int32()), ("name", pa.string()), ("arrow_type", pa.string())]))),
        ("piece", pa.int32()), ("first_group", pa.int32()), ("n_groups", pa.int32()), ("first_row", pa.int64()),
        ("bytes", pa.int64()), ("message", pa.string()),
    ]
)
ROW_TYPE = pa.schema(
    [
        ("path", pa.string()), ("chunk", pa.int32()), ("member", pa.string()), ("row_no", pa.int64()),
        ("cells", pa.list_(pa.string())), ("message", pa.string()),
    ]
)


def _open(path: str):
    store, inside = _store(path)
    return store.open_input_file(inside)


def _batches(rows: Iterator[dict], kind: pa.Schema, most: int = 1000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_pylist(held, kind)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, kind)


def decode_pieces(pieces: DataFrame) -> DataFrame:
    """The rows of all pieces, and a row with a message for each piece that can't be read or printed to its end."""

    def rows_of(piece: dict, archive: zipfile.ZipFile) -> Iterator[pa.RecordBatch]:
        groups = range(piece["first_group"], piece["first_group"] + piece["n_groups"])
        with archive.open(piece["member"]) as f:
            file = pq.ParquetFile(f)
            at, end = piece["first_row"], piece["first_row"] + sum(file.metadata.row_group(i).num_rows for i in groups)
            for batch in file.iter_batches(BATCH_ROWS, row_groups=list(groups)):
                if batch.num_rows:
                    yield _row_batch(piece, at, batch)
                at += batch.num_rows
            if at != end:
                raise ValueError(f"{end - at} rows are missing")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, archive = None, None
        for batch in batches:
            for piece in batch.to_pylist():
                try:
                    if piece["path"] != path:
                        path, archive = piece["path"], zipfile.ZipFile(_open(piece["path"]))
                    yield from rows_of(piece, archive)
                except Exception as e:  # noqa: BLE001 - whatever is wrong with a member is reported, not fatal
                    failed = {c: piece[c] for c in ("path", "chunk", "member")} | {"message": str(e) or type(e).__name__}
                    yield pa.RecordBatch.from_pylist([failed], ROW_TYPE)

    return pieces.select(*[c for c in pieces.columns if c != "columns"]).mapInArrow(run, DECODED)


def _row_batch(piece: dict, start: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    n, width = batch.num_rows, batch.num_columns
    texts = [arrow_text(c) for c in batch.columns]
    # Interleave the columns into one list per row.
    flat = pa.concat_arrays(texts) if width else pa.array([], pa.string())
    order = pa.array(np.arange(n * width).reshape(width, n).T.ravel())
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * width)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([piece["path"]] * n, pa.string()),
            pa.array([piece["chunk"]] * n, pa.int32()),
            pa.array([piece["member"]] * n, pa.string()),
            pa.array(range(start, start + n), pa.int64()),
            pa.ListArray.from_arrays(offsets, flat.take(order)),
            pa.nulls(n, pa.string()),
        ],
        schema=ROW_TYPE,
    )


def arrow_text(values: pa.Array) -> pa.Array:
    """Canonical cell text of one column; the same rules as for DataFrame columns."""
    kind = values.type
    if pa.types.is_dictionary(kind):
        return arrow_text(values.dictionary_decode())
    if pa.types.is_integer(kind) or pa.types.is_string(kind) or pa.types.is_large_string(kind):
        return pc.cast(values, pa.string())
    if pa.types.is_boolean(kind):
        return pc.if_else(values, "True", "False")
    if pa.types.is_float32(kind) or pa.types.is_float16(kind):
        single = np.float32 if pa.types.is_float32(kind) else np.float16
        return _each(values, lambda v: None if v != v else str(single(v)))
    if pa.types.is_float64(kind):
        return _each(values, lambda v: None if v != v else repr(v))
    if pa.types.is_timestamp(kind):
        micros = pc.cast(values, pa.timestamp("us", kind.tz), safe=False)
        return _each(micros, lambda v: v.replace(tzinfo=None).isoformat(" "))
    if pa.types.is_nested(kind):
        # As data frames hold them: arrays, dictionaries, and pairs of keys and values.
        return pa.array([None if v is None else str(v) for v in values.to_pandas()], pa.string())
    return _each(values, str)


def _each(values: pa.Array, text) -> pa.Array:
    return pa.array([None if v is None else text(v) for v in values.to_pylist()], pa.string())


class Archives(NamedTuple):
    corpus: Corpus
    errors: DataFrame


def read_archives(spark: SparkSession, archives: list[Archive], piece_bytes: int = BYTES_PER_PIECE) -> Archives:
    """Archives as a corpus, with what could not be read. Each member is decoded once and stored.

    A member of which any row group or value fails is refused as a whole and has one error; an unreadable
    archive has one with no member. A member without rows is a table without rows.
    """
    pieces = stage(member_pieces(spark, archives, piece_bytes))
    listed = pieces.where("message IS NULL")
    total = listed.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / BYTES_PER_TASK))
    dealt = listed.where("n_groups > 0").repartition(tasks, "path", "member", "piece")
    decoded = stage(decode_pieces(dealt.sortWithinPartitions("path", "member", "piece")))
    refused = decoded.where("message IS NOT NULL").groupBy("path", "chunk", "member").agg(F.min("message").alias("message"))
    errors = pieces.where("message IS NOT NULL").select(refused.columns).unionByName(refused)
    whole = decoded.where("message IS NULL").join(refused.select("path", "member"), ["path", "member"], "left_anti")
    tables = listed.where("piece = 0").join(refused.select("path", "member"), ["path", "member"], "left_anti")
    name = table_id(F.col("chunk"), F.col("member")).alias("table_id")
    rows = whole.select(
        "chunk",
        name,
        table_seed(F.col("member")).alias("seed"),
        F.lpad(F.col("row_no").cast("string"), 15, "0").alias("row_tag"),
        F.col("row_no").alias("row_pos"),
        F.lit(1).alias("n_copies"),
        "cells",
    )
    return Archives(Corpus(tables.select("chunk", name, "member", "columns"), rows, True), errors.select("chunk", "member", "message", name))


def read_table_archives(spark: SparkSession, folder: str, chunks: list[int] | None = None) -> Archives:
    """A folder of chunk archives as a corpus, with what could not be read."""
    return read_archives(spark, list_archives(folder, chunks))
