"""Token ids in raw shard files with a minimal perfect hash index.

A shard file is a header of HEAD bytes (magic, bytes per id) and the raw little-endian ids of its documents in
ascending doc_id order, each document closed by the end id. An index file covers the documents of one
hash bucket of keys. It holds a minimal perfect hash (levels of bit arrays: a key settles at the first level
where it is alone in its place, and its rank among settled places is its slot), a fingerprint per
slot, and per slot the shard, offset and length of the key's documents. A lookup takes a
constant number of steps, and a key that was never stored is told by its fingerprint (but for 1 in 2 ** 32).
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tablemill.llm.common import mix, new_folder, open_store, partitions, public_tokenizer, read, store_file, text_buffers
from tablemill.llm.queries import query
from tablemill.llm.units import encoder
from tablemill.session import stage

MAGIC, HEAD = b"TOKENID1", 16
#: Keys of an index file, about.
KEYS = 250_000
#: Places per key at each level.
ROOM = 1.5
#: The key that stands for a null doc_id.
NULL_KEY = -(1 << 63)


def _keys(column: pa.Array) -> np.ndarray:
    column = column.fill_null(NULL_KEY) if column.null_count else column
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, shards: int | None = None) -> DataFrame:
    """doc_id, shard, at, n, file: where each document's ids were written in `folder`.

    Shards are ranges of doc_id, in order; a null doc_id counts as smallest, rows of equal doc_id stand in the
    order of their texts, null texts are empty. Files of retried tasks aren't named in the result.
    """
    spark = docs.sparkSession
    shards = shards or partitions(spark)
    name = tokenizer
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, file, out, at = TaskContext.get().partitionId(), f"{uuid.uuid4().hex}.ids", None, 0
        coder = encoder(public_tokenizer(name))
        wide = np.uint16 if max(coder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else np.uint32
        for batch in batches:
            if out is None:
                out = store_file(folder, file)
                out.write(MAGIC + np.array([np.dtype(wide).itemsize], "<u8").tobytes())
            ids, offsets = coder.encode(*text_buffers(batch["text"]))
            whole = np.insert(ids.astype(wide), offsets[1:], end_id)
            out.write(whole.astype(np.dtype(wide).newbyteorder("<")).tobytes())
            n = np.diff(offsets) + 1
            start = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(np.full(len(n), shard, np.int32)), pa.array(start), pa.array(n), pa.array([file] * len(n))],
                ["doc_id", "shard", "at", "n", "file"],
            )
        if out is not None:
            out.close()

    return stage(rows.mapInArrow(put, "doc_id long, shard int, at long, n long, file string"))


def perfect_hash(keys: np.ndarray) -> dict[str, np.ndarray]:
    """Bit arrays (as bytes), their sizes and rank bases for distinct keys."""
    bits, sizes, left, level = [], [], keys.astype(np.uint64), 0
    while len(left):
        size = int(len(left) * ROOM) + 1
        place = _place(left, level, size)
        alone = np.bincount(place, minlength=size) == 1
        bits.append(alone)
        sizes.append(size)
        left, level = left[~alone[place]], level + 1
    flat = np.concatenate(bits) if bits else np.empty(0, bool)
    return {"bits": flat, "sizes": np.asarray(sizes, np.int64), "rank": np.cumsum(flat) - flat}


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)


def _ranks(index: dict[str, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The slots of stored keys, and some slot or -1 for others."""
    out, base, waiting = np.full(len(keys), -1, np.int64), 0, np.arange(len(keys))
    for level, size in enumerate(index["sizes"].tolist()):
        place = base + _place(keys[waiting], level, size)
        here = index["bits"][place]
        out[waiting[here]] = index["rank"][place[here]]
        waiting, base = waiting[~here], base + size
    return out


def slots(index: dict[str, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The slot of each key; -1 where the fingerprint shows that the key isn't there."""
    keys = keys.astype(np.uint64)
    out = _ranks(index, keys)
    found = np.flatnonzero(out >= 0)
    out[found[index["prints"][out[found]] != _prints(keys[found])]] = -1
    return out


def _prints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)


def build_index(keys: np.ndarray, shard: np.ndarray, at: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """An index over documents, of which several may share a key."""
    distinct = np.unique(keys)
    index = perfect_hash(distinct)
    index["prints"] = np.zeros(len(distinct), np.uint32)
    own = _ranks(index, distinct.astype(np.uint64))
    index["prints"][own] = _prints(distinct.astype(np.uint64))
    slot = own[np.searchsorted(distinct, keys)]
    order = np.lexsort((at, shard, slot))
    index["first"] = np.searchsorted(slot[order], np.arange(len(distinct) + 1))
    index |= {"shard": shard[order], "at": at[order], "n": n[order]}
    return index


def write_index(placed: DataFrame, folder: str) -> DataFrame:
    """bucket, file, keys: index files over the documents of `placed`, one per hash bucket of doc_id."""
    spark = placed.sparkSession
    n_buckets = max(1, -(-placed.count() // KEYS))
    rows = placed.select(_bucket(n_buckets).alias("bucket"), "doc_id", "shard", "at", "n")
    rows = rows.repartition(max(n_buckets, partitions(spark)), "bucket").sortWithinPartitions("bucket")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, part in whole_groups(batches):
            index = build_index(_keys(part["doc_id"]), *(part[c].to_numpy(zero_copy_only=False) for c in ("shard", "at", "n")))
            file, packed = f"{uuid.uuid4().hex}.index", io.BytesIO()
            np.savez(packed, **{k: v for k, v in index.items() if k != "rank"} | {"bits": np.packbits(index["bits"])})
            with store_file(folder, file) as out:
                out.write(packed.getvalue())
            yield pa.RecordBatch.from_arrays(
                [pa.array([bucket], pa.int32()), pa.array([file]), pa.array([len(index["prints"])])], ["bucket", "file", "keys"]
            )

    made = stage(rows.mapInArrow(put, "bucket int, file string, keys long"))
    return made.withColumn("n_buckets", F.lit(n_buckets))


def _bucket(n: int):
    return F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Rows of each value of the first column, which come in order; groups must be of bounded size."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        key = batch[0].to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held and held[0][0][0].as_py() != key[a]:
                yield held[0][0][0].as_py(), pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield held[0][0][0].as_py(), pa.Table.from_batches(held).combine_chunks()


def load_index(uri: str) -> dict[str, np.ndarray]:
    store, path = open_store(uri)
    with store.open_input_file(path) as file:
        index = dict(np.load(io.BytesIO(file.read())))
    size = int(index["sizes"].sum())
    index["bits"] = np.unpackbits(index["bits"], count=size).astype(bool)
    index["rank"] = np.cumsum(index["bits"]) - index["bits"]
    return index


def lookup(keys: DataFrame, index: DataFrame, folder: str) -> DataFrame:
    """doc_id, shard, at, n of the documents of `keys` (doc_id, distinct) by the index files.

    Keys that aren't in the index give no row.
    """
    spark = keys.sparkSession
    first = index.select("n_buckets").first()
    if first is None:
        return keys.selectExpr("doc_id", "0 AS shard", "0L AS at", "0L AS n").limit(0)
    files = index.select("bucket", "file")
    asked = keys.select(_bucket(first[0]).alias("bucket"), "doc_id").join(files, "bucket")
    asked = asked.select("bucket", "file", "doc_id").repartition(max(first[0], partitions(spark)), "bucket").sortWithinPartitions("bucket")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, table = None, None
        for batch in batches:
            names = batch["file"].to_numpy(zero_copy_only=False)
            for name in dict.fromkeys(names.tolist()):
                part = batch.filter(pa.array(names == name))
                if name != now:
                    now, table = name, load_index(f"{folder}/{name}")
                slot = slots(table, _keys(part["doc_id"]))
                had = np.flatnonzero(slot >= 0)
                first, last = table["first"][slot[had]], table["first"][slot[had] + 1]
                row = np.repeat(had, last - first)
                at = np.repeat(first - (np.cumsum(last - first) - (last - first)), last - first) + np.arange(int((last - first).sum()))
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"].take(pa.array(row)), pa.array(table["shard"][at].astype(np.int32)), pa.array(table["at"][at]), pa.array(table["n"][at])],
                    ["doc_id", "shard", "at", "n"],
                )

    return asked.mapInArrow(find, "doc_id long, shard int, at long, n long")


def read_ids(found: DataFrame, manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of looked-up documents, read from the shard files.

    `manifest` has shard, file and base (ids in all shards before). Documents of a shard are read in
    the order of their offsets.
    """
    rows = found.join(manifest, "shard").select("shard", "file", "base", "doc_id", "at", "n")
    rows = rows.repartition(partitions(found.sparkSession), "shard").sortWithinPartitions("shard", "at")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, file, width = None, None, 2
        for batch in batches:
            crc = []
            for name, at, n in zip(*(batch[c].to_pylist() for c in ("file", "at", "n")), strict=True):
                if name != now:
                    store, path = open_store(f"{folder}/{name}")
                    now, file = name, store.open_input_file(path)
                    head = file.read_at(HEAD, 0)
                    if head[:8] != MAGIC:
                        raise ValueError(f"{name} is no shard file")
                    width = int.from_bytes(head[8:], "little")
                raw = file.read_at(n * width, HEAD + at * width)
                crc.append(zlib.crc32(np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes()))
            start = batch["base"].to_numpy(zero_copy_only=False) + batch["at"].to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(start), batch["n"], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(scan, "doc_id long, start long, n_tokens long, ids_crc32 long")


def manifest_of(placed: DataFrame) -> DataFrame:
    """shard, file, base, ids of the shard files: one row each."""
    shards = placed.groupBy("shard", "file").agg(F.sum("n").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return stage(shards.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0))))


@query("op8_token_id_output")
def op8_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, written, indexed, looked up by key and read back."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    folder = new_folder(spark, "ids")
    placed = write_shards(docs, folder, "word_bpe_49k.json")
    index = write_index(placed, folder)
    found = lookup(docs.select("doc_id").distinct(), index, folder)
    return read_ids(found, manifest_of(placed).select("shard", "file", "base"), folder)
