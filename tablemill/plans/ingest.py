"""Landed archives to segments, as a stream of drops.

Spark's file source keeps the names of archives that it has handed out in the query's checkpoint; each micro-batch of
names goes through the plan that reads a whole folder. A batch's segments, table ids and errors are committed
together under the batch's number, so that a batch which is run again after a failure adds nothing.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tablemill.constants import TOKEN_BUDGET
from tablemill.functions.tokens import Tokenizer, count_words
from tablemill.plans.serialize import prepare, serialize
from tablemill.sources import commits, files
from tablemill.sources.archives import Archive, chunk_number, read_archives

FILES = "path string, modificationTime timestamp, length bigint, content binary"
TABLES = "table_id string, chunk int, n_rows bigint"
ERRORS = "table_id string, chunk int, member string, message string"
SEGMENTS = "text string, format string, chunk int"
#: Archives in a micro-batch; more that land together go in several.
ARCHIVES_PER_BATCH = 32


class Landed(NamedTuple):
    """What the committed batches hold; `batch` says which brought a row."""

    segments: DataFrame
    tables: DataFrame
    errors: DataFrame


def landed_archives(spark: SparkSession, folder: str, per_batch: int = ARCHIVES_PER_BATCH) -> DataFrame:
    """A stream of (path, length) of the chunk archives that land in a folder, each once; contents aren't read.

    An archive has to appear under its name when it is complete, by a rename or an atomic upload.
    """
    reader = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "chunk-*.zip")
    # Archives count whatever their age, and whichever of them came first.
    reader = reader.option("maxFilesPerTrigger", per_batch).option("maxFileAge", "36500d")
    return reader.load(folder).select("path", "length")


def ingest(
    batch: DataFrame, number: int, out: str, chunks: list[int] | None = None, budget: int = TOKEN_BUDGET, tokenizer: Tokenizer = count_words
) -> None:
    """One drop of archives: segments, ids and errors, unless the batch is committed already."""
    spark, name, log = batch.sparkSession, f"{number:09d}", f"{out}/_committed"
    if name in commits.committed(spark, log):
        return
    # Names and sizes of a drop, a bounded number.
    named = [Archive(r["path"], chunk_number(r["path"]), r["length"]) for r in batch.collect()]
    wanted = sorted(a for a in named if a.chunk is not None and (chunks is None or a.chunk in chunks))
    found = read_archives(spark, wanted)
    prepared = prepare(found.corpus)
    files.write_segments(serialize(prepared, budget, tokenizer), f"{out}/segments", name)
    commits.write_batch(prepared.tables.select("table_id", "chunk", "n_rows"), f"{out}/tables", name, "parquet")
    commits.write_batch(found.errors.select("table_id", "chunk", "member", "message"), f"{out}/errors", name)
    commits.commit(spark, log, name)


def serialize_landed(
    spark: SparkSession,
    folder: str,
    out: str,
    chunks: list[int] | None = None,
    budget: int = TOKEN_BUDGET,
    tokenizer: Tokenizer = count_words,
    per_batch: int = ARCHIVES_PER_BATCH,
    every: str | None = None,
) -> StreamingQuery:
    """Start serialising what lands in `folder`: all that is there now, or, with an interval in `every`, for ever.

    Started again with the same `out` it goes on after the last finished batch.
    """
    writer = landed_archives(spark, folder, per_batch).writeStream.option("checkpointLocation", f"{out}/_stream")
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.foreachBatch(lambda batch, number: ingest(batch, number, out, chunks, budget, tokenizer)).start()


def read_landed(spark: SparkSession, out: str) -> Landed:
    """Committed segments, table ids and errors."""
    log = f"{out}/_committed"
    return Landed(
        commits.read_batches(spark, f"{out}/segments", log, SEGMENTS),
        commits.read_batches(spark, f"{out}/tables", log, TABLES, "parquet"),
        commits.read_batches(spark, f"{out}/errors", log, ERRORS),
    )
