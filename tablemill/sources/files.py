"""File sources and sinks: segments, pairs, results, completed ids, index files, curves."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablemill.constants import INDEX_HEADER_BYTES, INDEX_MAGIC, INDEX_TYPE_CODES
from tablemill.sources.commits import path_exists, read_batches, write_batch

PAIR_LINES = "table_id string, statement string, distractor string, type string, table_serialized string"
RESULT_LINES = (
    "run_id string, format string, table_id string, type string, statement string, "
    "distractor string, nll_statement double, nll_distractor double, correct boolean"
)


# --- sinks -----------------------------------------------------------------


def write_segments(segments: DataFrame, path: str, batch: str | None = None) -> None:
    """`{"text": ...}` lines by format and chunk; a rerun replaces what was there, or the same batch."""
    chunk = F.regexp_extract("table_id", "^chunk([0-9]+)__", 1).cast("int")
    lines = segments.select("format", chunk.alias("chunk"), "text")
    _put(_gathered(lines, "format", "chunk"), path, batch, "json", ("format", "chunk"), "overwrite")


def write_pairs(fanned: DataFrame, path: str, batch: str | None = None) -> None:
    _put(fanned, path, batch, "json", ("format",))


def write_ground_truth(pairs: DataFrame, path: str, batch: str | None = None) -> None:
    _put(pairs.select("table_id", "statement", "distractor", "type"), path, batch, "json")


def write_clean_tables(rows: DataFrame, path: str, batch: str | None = None) -> None:
    _put(_gathered(rows, "chunk"), path, batch, "parquet", ("chunk",), "overwrite")


def write_results(results: DataFrame, path: str, batch: str | None = None) -> None:
    _put(results, path, batch, "json", ("run_id",))


def _gathered(df: DataFrame, *by: str) -> DataFrame:
    """Rows that go into one folder in one task, or in several if they are many.

    Packed and joined rows are partitioned by table, and nearly every task has tables of every chunk: each would
    write a file of its own into every folder. The planner cuts partitions that are too large, so a large chunk isn't one task's work.
    """
    return df.hint("rebalance", *by)


def _put(df: DataFrame, path: str, batch: str | None, form: str, by: tuple[str, ...] = (), mode: str = "append") -> None:
    """As files of a batch, which count once it is committed, or at once."""
    if batch is None:
        df.write.partitionBy(*by).mode(mode).format(form).save(path)
    else:
        write_batch(df, path, batch, form, by)


def write_summary(summary: DataFrame, path: str) -> None:
    """A document of a few rows, as one file."""
    summary.coalesce(1).write.mode("overwrite").json(path)


SUMMARY = (
    "run_id string, format string, n_pairs bigint, n_processed bigint, n_skipped bigint, overall_accuracy double, "
    "by_type map<string, struct<correct: bigint, total: bigint, accuracy: double>>"
)
ASSESSMENT = (
    "exp string, ckpt_dir string, iters array<bigint>, latest_iter bigint, store_ckpt_dir string, "
    "store_iters array<bigint>, location string, format string, seed bigint, jobid string"
)
TOKEN_STATS = (
    "format string, n_shards bigint, total_segments bigint, total_tokens bigint, "
    "shards array<struct<shard: string, segments: bigint, tokens: bigint>>"
)
PLAN = (
    "experiment string, format string, seed bigint, real_ckpt_dir string, final_iter bigint, target_iter bigint, "
    "matched_iter bigint, rows_delta_pct double, view_ckpt_dir string, step_dir string"
)


def write_assessment(runs: DataFrame, path: str) -> None:
    """One line per experiment; a rerun replaces what was there."""
    runs.write.mode("overwrite").json(path)


def read_assessment(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ASSESSMENT).json(path)


def write_token_stats(stats: DataFrame, path: str) -> None:
    """One line per format with its shards."""
    stats.write.mode("overwrite").json(path)


def read_token_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TOKEN_STATS).json(path)


def write_plan(plan: DataFrame, path: str) -> None:
    """One line per selected run."""
    plan.write.mode("overwrite").json(path)


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PLAN).json(path)


def append_completed(ids: DataFrame, path: str, batch: str | None = None) -> None:
    _put(ids.select("table_id"), path, batch, "text")


def write_token_ids(tokens: DataFrame, path: str) -> None:
    tokens.write.partitionBy("format", "shard").mode("overwrite").parquet(path)


def candidate_cache(candidates: DataFrame, path: str) -> DataFrame:
    """Use the stored result if there is one, else compute and store it."""
    spark = candidates.sparkSession
    if not path_exists(spark, f"{path}/_SUCCESS"):
        candidates.write.mode("overwrite").parquet(path)
    return spark.read.schema(candidates.schema).parquet(path)


# --- sources -----------------------------------------------------------------


def distinct_ids(lines: DataFrame) -> DataFrame:
    """Ids from a text column `value`: trimmed, blank ones dropped."""
    return (
        lines.select(F.trim("value").alias("table_id")).filter("table_id <> ''").distinct()
    )


def completed_ids(spark: SparkSession, path: str, log: str | None = None) -> DataFrame:
    """Finished ids of a list, or of the committed batches of a list."""
    if log is not None:
        return distinct_ids(read_batches(spark, path, log, "value string", "text"))
    if not path_exists(spark, path):
        return spark.createDataFrame([], "table_id string")
    return distinct_ids(spark.read.text(path))


def default_type(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("type", F.coalesce("type", F.lit("unknown")))


def read_pairs(spark: SparkSession, path: str, log: str | None = None) -> DataFrame:
    """Pair lines; blank lines do not count, a missing type is `unknown`. With a log, those of committed batches."""
    if log is not None:
        return default_type(read_batches(spark, path, log, f"{PAIR_LINES}, format string"))
    return default_type(spark.read.schema(PAIR_LINES).json(path))


def read_results(spark: SparkSession, path: str, log: str | None = None) -> DataFrame:
    if log is not None:
        return read_batches(spark, path, log, RESULT_LINES).drop("batch")
    if not path_exists(spark, path):
        return spark.createDataFrame([], RESULT_LINES)
    return spark.read.schema(RESULT_LINES).json(path)


def trim_formats(points: DataFrame) -> DataFrame:
    return points.withColumn("format", F.trim("format"))


def loss_curve_csv(spark: SparkSession, path: str) -> DataFrame:
    return trim_formats(
        spark.read.csv(path, header=True, schema="format string, step double, loss double")
    )


def index_totals(content: bytes) -> tuple[int, int] | None:
    """Sequences and tokens of an index file, None if it is not one."""
    if not content.startswith(INDEX_MAGIC) or len(content) < INDEX_HEADER_BYTES:
        return None
    _, code, sequences, _ = struct.unpack_from("<QBQQ", content, len(INDEX_MAGIC))
    lengths = content[INDEX_HEADER_BYTES : INDEX_HEADER_BYTES + 4 * sequences]
    if code not in INDEX_TYPE_CODES or len(lengths) % 4:
        return None
    lengths = np.frombuffer(lengths, dtype="<i4")
    return sequences, int(lengths.sum(dtype=np.int64))


def shard_index_stats(spark: SparkSession, root: str) -> DataFrame:
    """`(format, shard, segments, tokens)` of `<root>/<format>/**/*.idx`; NULLs if unreadable."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.idx")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path", "content")
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals = [index_totals(c.as_py()) or (None, None) for c in batch.column("content")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("path"),
                    pa.array([t[0] for t in totals], pa.int64()),
                    pa.array([t[1] for t in totals], pa.int64()),
                ],
                names=["path", "segments", "tokens"],
            )

    counted = files.mapInArrow(decode, "path string, segments bigint, tokens bigint")
    return counted.select(*_shard_names(root), "segments", "tokens")


def data_file_sizes(spark: SparkSession, root: str) -> DataFrame:
    """`(format, shard, bytes)` of the data files beside the indexes, without reading them."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.bin")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select(*_shard_names(root), F.col("length").alias("bytes"))
    )


def _shard_names(root: str):
    below = F.substring_index("path", root.rstrip("/") + "/", -1)
    return (
        F.substring_index(below, "/", 1).alias("format"),
        F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.(idx|bin)$", "").alias("shard"),
    )
