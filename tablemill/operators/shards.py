"""Token sequences in shards, shard choice, and the split into train and valid."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablemill.constants import TOKEN_SHARDS, TRAIN_PER_MILLE, TRAIN_SHARDS
from tablemill.functions.tokens import file_ids, words
from tablemill.operators.prefix import prefix_sums
from tablemill.session import stage

#: Characters of text whose words share a dictionary.
BATCH_BYTES = 16 << 20
BATCHES = (
    "batch string, formats array<string>, tables array<string>, numbers array<bigint>, sizes array<int>, "
    "codes array<int>, words array<string>, counts array<bigint>"
)


def hash_bucket(key: Column, buckets: int) -> Column:
    """A bucket from the first eight hex digits of an MD5, the same on every engine."""
    digits = F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10)
    return F.pmod(digits.cast("bigint"), F.lit(buckets)).cast("int")


def dictionary_batches(segments: DataFrame, most: int = BATCH_BYTES) -> DataFrame:
    """One row per batch of segments of at most `most` bytes of text, or of one longer segment.

    `words` are the batch's different words and `counts` how often they occur; `codes` are the segments' words, one
    segment after the other, as positions in that list, and `sizes` how many each segment has. The
    segments are named by `formats`, `tables` and `numbers`. NULL texts have no words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            ends = np.cumsum([len(t or "") for t in texts])
            first = 0
            while first < len(texts):
                limit = (ends[first - 1] if first else 0) + most
                last = max(first + 1, int(np.searchsorted(ends, limit, "right")))
                yield _batch(batch.slice(first, last - first), texts[first:last])
                first = last

    return segments.select("format", "table_id", "seg_no", "text").mapInArrow(run, BATCHES)


def _batch(named: pa.RecordBatch, texts: list[str | None]) -> pa.RecordBatch:
    split = [(t or "").split() for t in texts]
    codes, words = pd.factorize(np.array(list(itertools.chain.from_iterable(split)), dtype=object))
    lists = {
        "formats": named["format"],
        "tables": named["table_id"],
        "numbers": named["seg_no"].cast(pa.int64()),
        "sizes": pa.array([len(s) for s in split], pa.int32()),
        "codes": pa.array(codes.astype(np.int32)),
        "words": pa.array(words.tolist(), pa.string()),
        "counts": pa.array(np.bincount(codes, minlength=len(words)).astype(np.int64)),
    }
    whole = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in lists.values()]
    return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), *whole], ["batch", *lists])


def vocabulary(texts: DataFrame) -> DataFrame:
    """`(token, n, token_id)` of a column `text`: ids by falling frequency, then by token."""
    counted = texts.select(F.explode(words(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return ranked(counted)


def batch_vocabulary(batches: DataFrame) -> DataFrame:
    """The vocabulary of all batches, from their dictionaries: a row per batch and different word."""
    each = batches.select(F.explode(F.arrays_zip("words", "counts")).alias("w")).select(F.col("w.words").alias("token"), "w.counts")
    return ranked(each.groupBy("token").agg(F.sum("counts").alias("n")))


def ranked(counts: DataFrame) -> DataFrame:
    """`(token, n)` with ids by falling frequency, then by token.

    Tokens are dealt by ranges of that order; a token's id is its rank in its range plus the sizes of the
    ranges before, which are one number per partition.
    """
    spark = counts.sparkSession
    pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Stored, so that a token's range stays what it was when a task is repeated.
    counted = stage(counts.withColumn("bytes", F.col("token").cast("binary")))
    ranged = stage(counted.repartitionByRange(pieces, F.desc("n"), "bytes").withColumn("range", F.spark_partition_id()))
    within = Window.partitionBy("range").orderBy(F.desc("n"), "bytes")
    sizes = {r["range"]: r["size"] for r in ranged.groupBy("range").agg(F.count(F.lit(1)).alias("size")).collect()}
    bases, so_far = [], 0
    for number in sorted(sizes):
        bases.append((number, so_far))
        so_far += sizes[number]
    return ranged.join(F.broadcast(spark.createDataFrame(bases, "range int, base long")), "range").select(
        "token", "n", (F.col("base") + F.row_number().over(within) - 1).alias("token_id")
    )


def batch_ids(batches: DataFrame, vocab: DataFrame) -> DataFrame:
    """The segments of dictionary batches as id sequences with the shard they go to.

    A batch's different words meet the vocabulary and come back as one array of ids, as long as the batch's
    dictionary; its segments are then looked up where they are. No row stands for a single occurrence.
    """
    each = batches.select("batch", F.posexplode("words").alias("pos", "token")).join(vocab.select("token", "token_id"), "token")
    ids = each.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("pos", "token_id"))).alias("found"))
    # A batch without words has no ids.
    coded = batches.drop("words", "counts").join(ids.select("batch", F.col("found.token_id").alias("ids")), "batch", "left")

    def decode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (rows_.slice(i, 1) for rows_ in rows for i in range(rows_.num_rows)):
            own = {c: row[c].flatten() for c in ("formats", "tables", "numbers", "sizes", "codes", "ids")}
            found = own["ids"].to_numpy()[own["codes"].to_numpy()] if len(own["codes"]) else np.empty(0, np.int64)
            ends = np.concatenate(([0], np.cumsum(own["sizes"].to_numpy()))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(found.astype(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [own["formats"], own["tables"], own["numbers"], lists], ["format", "table_id", "seg_no", "token_ids"]
            )

    found = coded.mapInArrow(decode, "format string, table_id string, seg_no bigint, token_ids array<bigint>")
    return _sharded(found).where(F.size("token_ids") > 0)


def _sharded(found: DataFrame) -> DataFrame:
    shard = hash_bucket(F.concat_ws("-", "table_id", F.col("seg_no").cast("string")), TOKEN_SHARDS)
    return found.select("format", shard.alias("shard"), "table_id", "seg_no", "token_ids")


def tokenize_segments(segments: DataFrame, vocab: DataFrame | None = None) -> DataFrame:
    """`(format, shard, table_id, seg_no, token_ids)` of all segments with words, by their own vocabulary or a given one.

    Texts are split into words once. With a given vocabulary words that it lacks raise no error: it must
    hold them all.
    """
    batches = stage(dictionary_batches(segments))
    return batch_ids(batches, stage(batch_vocabulary(batches)) if vocab is None else vocab)


def encode_segments(segments: DataFrame, path: str) -> DataFrame:
    """The same under a tokenizer file: no vocabulary, no shuffle. The shards are those of `tokenize_segments`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named, first = batch.select(["format", "table_id", "seg_no"]), 0
            for ids in file_ids(path, batch["text"]):
                own = named.slice(first, len(ids))
                first += len(ids)
                columns = [own["format"], own["table_id"], own["seg_no"].cast(pa.int64()), ids]
                yield pa.RecordBatch.from_arrays(columns, ["format", "table_id", "seg_no", "token_ids"])

    found = segments.select("format", "table_id", "seg_no", "text").mapInArrow(run, "format string, table_id string, seg_no bigint, token_ids array<bigint>")
    return _sharded(found).where(F.size("token_ids") > 0)


def shard_select(sizes: DataFrame, wanted: int = TRAIN_SHARDS) -> DataFrame:
    """The first shards of every format with weight 1.0; `present` is false for those to skip."""
    every = sizes.select("format").distinct().withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(wanted - 1)))
    )
    return every.join(sizes, ["format", "shard"], "left").select(
        "format",
        "shard",
        (F.coalesce("bytes", F.lit(0)) > 0).alias("present"),
        F.when(F.coalesce("bytes", F.lit(0)) > 0, 1.0).alias("weight"),
    )


def train_valid_split(tables: DataFrame) -> DataFrame:
    """Whole tables to train or valid, by hash."""
    return tables.withColumn(
        "part",
        F.when(hash_bucket(F.col("table_id"), 1000) < TRAIN_PER_MILLE, "train").otherwise("valid"),
    )


def split_by_position(documents: DataFrame, by: list[str], per_mille: int = TRAIN_PER_MILLE) -> DataFrame:
    """Documents `(..., n_tokens)` with `first_token`, the tokens before each, and its `part`.

    The documents in the order of `by`, which must be unique, are one sequence; those that begin in its first
    per_mille / 1000 tokens are for training, the rest for validation. So the shares are met to within one
    document. A NULL count is 0.
    """
    placed = stage(prefix_sums(documents, [], by, ["n_tokens"]))
    total = placed.agg(F.coalesce(F.max("n_tokens_to"), F.lit(0))).first()[0]
    first = F.col("n_tokens_to") - F.coalesce("n_tokens", F.lit(0))
    part = F.when(first * 1000 < total * per_mille, "train").otherwise("valid")
    return placed.select(*documents.columns, first.cast("bigint").alias("first_token"), part.alias("part"))
