"""Helpers of the text operators: whole-table reads, let-bindings, word scanning over Arrow buffers."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablemill.session import shared_folder, stage

#: ASCII white space; everything else belongs to words.
SPACES = b" \t\n\x0b\x0c\r"
#: Bytes handled at once by vectorised scans; a longer document is scanned alone.
SLICE_BYTES = 2 << 20
#: Powers in one of the two tables that `powers` multiplies.
POWER_STEP = 2048


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it in `body` as often as needed."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def partitions(spark: SparkSession) -> int:
    """Pieces that hashed exchanges are cut into; the cluster sizes this setting to its input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most `most` bytes together, or one longer document."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True


def word_bounds(body: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of the words, and n + 1 indexes of the documents' first words; `space` marks the bytes between words."""
    if not len(body):
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~space[body]
    edge = np.zeros(len(body) + 1, bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(starts)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def process_cache(kind: str, large: bool = False) -> dict:
    """A dictionary that lives as long as the Python process.

    Functions travel to tasks by value, so that a module's own globals would be new in each task. Large
    caches have one owner at a time: asking for one empties those of the operators that ran before.
    """
    import pyspark

    kept = pyspark.__dict__.setdefault("_kept_by_process", {})
    if large:
        for other in kept.get("large caches", {}).keys() - {kind}:
            kept[other].clear()
        kept["large caches"] = {kind: True}
    return kept.setdefault(kind, {})


def _tables(seed: int) -> tuple[np.ndarray, int, int]:
    """A random value for each byte (0 for white space), an odd base and its inverse."""
    kept = process_cache("tables")
    if seed not in kept:
        kept[seed] = _new_tables(seed)
    return kept[seed]


def _new_tables(seed: int) -> tuple[np.ndarray, int, int]:
    rng = np.random.default_rng(seed)
    values = rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    values[list(SPACES)] = 0
    base = int(rng.integers(1 << 40, 1 << 62)) * 8 + 5
    return values, base, pow(base, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. n - 1 modulo 2 ** 64, as products of two short tables; nothing is kept."""
    low = _geometric(base, min(n, POWER_STEP))
    if n <= POWER_STEP:
        return low
    high = _geometric(pow(base, POWER_STEP, 1 << 64), -(-n // POWER_STEP))
    return np.multiply.outer(high, low).ravel()[:n]


def _geometric(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def word_hashes(body: np.ndarray, starts: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit fingerprint of each word's bytes, the same wherever the word stands."""
    if not len(starts):
        return np.empty(0, np.uint64)
    values, base, inverse = _tables(seed)
    weighted = values[body] * powers(base, len(body))
    return mix(np.add.reduceat(weighted, starts) * powers(inverse, len(body))[starts])


def public_tokenizer(name: str) -> str:
    """The place of a public tokenizer file, on whichever machine asks."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def stage_and_free(df: DataFrame) -> DataFrame:
    """`stage`, after which the shuffle files that made the table are deleted at once."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name)
    conf.set(name, "true")
    try:
        return stage(df)
    finally:
        conf.set(name, before)


def open_store(uri: str):
    """The Arrow file system of a shared folder or file (local, HDFS, object stores) and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh folder under the one that all executors share; the caller cleans up."""
    return f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def store_file(folder: str, name: str):
    """A new file in a shared folder, to write bytes to."""
    store, path = open_store(folder)
    store.create_dir(path, recursive=True)
    return store.open_output_stream(f"{path}/{name}", compression=None)
