"""BPE encoding and decoding with content-defined chunk reuse.

Texts are cut where a rolling hash of the last ROLL bytes has its upper bits zero, so equal passages are cut
alike wherever they stand. Chunks that several documents of a batch share are encoded once. A cut may
fall inside a word: the chunks' tokens of that word are then wrong. Each such join is repaired by
encoding the broken word again with a whole word on either side; if those neighbours' ids aren't
exactly what the chunks say, the window grows until both sides agree or the document ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tablemill.llm.common import SLICE_BYTES, mix, powers, process_cache, public_tokenizer, read, slices, text_buffers, word_bounds
from tablemill.llm.queries import query
from tablemill.llm.units import Encoder, encoder, gather, load

#: Bytes that the rolling hash sees; a power of two.
ROLL = 8
#: Mean chunk length in bytes, a power of two.
MEAN = 1024
#: Bytes of text whose chunks are shared.
BATCH_BYTES = 8 << 20


def cut_points(body: np.ndarray, offsets: np.ndarray, mean: int = MEAN) -> np.ndarray:
    """Bounds of the chunks: every document's bounds and the cuts inside, at starts of characters; `mean` is a power of two."""
    n = len(body)
    bounds = np.unique(offsets)
    if n <= ROLL:
        return bounds
    shift = np.uint64(64 - (mean.bit_length() - 1))
    found = []
    for low in range(0, n - ROLL, SLICE_BYTES):
        rolled, width, weight = body[low : low + SLICE_BYTES + ROLL - 1].astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
        while width < ROLL:
            rolled = rolled[:-width] * np.uint64(weight) + rolled[width:]
            width, weight = 2 * width, weight * weight % (1 << 64)
        found.append(np.flatnonzero((rolled * np.uint64(0xD6E8FEB86659FD93)) >> shift == 0) + (low + ROLL))
    cuts = np.concatenate(found)
    cuts = cuts[cuts < n]
    cuts = cuts[(body[cuts] & 0xC0) != 0x80]
    # The hash must not reach into the document before.
    home = np.searchsorted(offsets, cuts, "right") - 1
    return np.union1d(bounds, cuts[cuts - offsets[home] >= ROLL])


def _byte_values(seed: int) -> np.ndarray:
    kept = process_cache("byte values")
    if seed not in kept:
        kept[seed] = np.random.default_rng(seed).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    return kept[seed]


def chunk_hashes(body: np.ndarray, bounds: np.ndarray, seed: int) -> np.ndarray:
    """64-bit fingerprints of body[bounds[i] : bounds[i + 1]]."""
    base = 0xD1342543DE82EF95 + 8 * seed
    out = []
    for a, b in slices(bounds):
        lo, hi = bounds[a], bounds[b]
        weighted = _byte_values(seed)[body[lo:hi]] * powers(base, int(hi - lo))
        at = bounds[a:b] - lo
        out.append(np.add.reduceat(weighted, at) * powers(pow(base, -1, 1 << 64), int(hi - lo))[at])
    return mix(np.concatenate(out) ^ np.diff(bounds).astype(np.uint64)) if out else np.empty(0, np.uint64)


def encode_chunked(coder: Encoder, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the documents of a batch and n + 1 offsets into them."""
    bounds = cut_points(body, offsets)
    n = len(bounds) - 1
    if n < 1:
        return np.empty(0, np.uint16), np.zeros(len(offsets), np.int64)
    key, check = chunk_hashes(body, bounds, 1), chunk_hashes(body, bounds, 2)
    _, first, back = np.unique(key, return_index=True, return_inverse=True)
    if not np.array_equal(check[first][back], check):
        raise ValueError("two chunks share a fingerprint; change the seed")
    # Each different chunk once, end to end.
    size = np.diff(bounds)
    own = np.concatenate(([0], np.cumsum(size[first])))
    ids, by_word, words = coder.encode_by_word(gather(body, bounds[first], size[first]), own)
    token = np.concatenate(([0], np.cumsum(by_word)))
    start, end, word_from, word_to = token[words[:-1]][back], token[words[1:]][back], words[:-1][back], words[1:][back]

    # Words that a cut goes through, by their first cut.
    starts, ends, _ = word_bounds(body, offsets)
    cut = bounds[1:-1]
    word = np.searchsorted(starts, cut, "right") - 1
    inside = (word >= 0) & (starts[word] < cut) & (cut < ends[word]) if len(starts) else np.zeros(len(cut), bool)
    broken_cut = np.flatnonzero(inside)
    broken, first_cut = np.unique(word[broken_cut], return_index=True)
    # A chunk loses its last word if its end is broken and its first if its start is.
    tail, head = np.zeros(n, bool), np.zeros(n, bool)
    tail[broken_cut], head[broken_cut + 1] = True, True
    lone = word_to - word_from == 1
    drop_last, drop_first = tail & (word_to > word_from), head & (word_to > word_from) & ~(lone & tail)
    start = start + np.where(drop_first, by_word[np.minimum(word_from, len(by_word) - 1)] if len(by_word) else 0, 0)
    end = end - np.where(drop_last, by_word[np.maximum(word_to - 1, 0)] if len(by_word) else 0, 0)

    fixed, fixed_size = _repair(coder, body, offsets, starts, ends, broken)
    order = np.argsort(np.concatenate([2 * np.arange(n), 2 * broken_cut[first_cut] + 1]), kind="stable")
    kind = np.result_type(ids.dtype, fixed.dtype)
    pool = np.concatenate([ids.astype(kind), fixed.astype(kind)])
    at = np.concatenate([start, len(ids) + np.cumsum(fixed_size) - fixed_size])[order]
    length = np.concatenate([end - start, fixed_size])[order]
    where = np.concatenate([bounds[:-1], starts[broken]])[order]
    total = np.concatenate(([0], np.cumsum(length)))
    # A piece belongs to the document that its first byte is in.
    return gather(pool, at, length), total[np.searchsorted(where, offsets)] if len(where) else np.zeros(len(offsets), np.int64)


def _repair(coder: Encoder, body, offsets, starts, ends, broken) -> tuple[np.ndarray, np.ndarray]:
    """Ids of broken words, taken from windows whose outer words agree with their own encoding."""
    home = np.searchsorted(offsets, starts[broken], "right") - 1
    low, high = np.searchsorted(starts, offsets[home]), np.searchsorted(starts, offsets[home + 1])
    seen: dict[bytes, list[int]] = {}
    ids, size = [], np.zeros(len(broken), np.int64)
    for k, (word, lo, hi) in enumerate(zip(broken.tolist(), low.tolist(), high.tolist(), strict=True)):
        reach = 1
        a, b = max(lo, word - reach), min(hi - 1, word + reach)
        text = body[starts[a] : ends[b]].tobytes()
        mark = text + b"\0%d" % (word - a)
        got = seen.get(mark)
        while got is None:
            whole = coder.tokenizer.encode(text.decode(), add_special_tokens=False).ids
            parts = [body[starts[i] : ends[i]].tobytes().decode() for i in range(a, b + 1)]
            alone, counts = coder.encode_words(parts)
            edge = np.cumsum(counts)
            i = word - a
            left, right = (int(edge[i - 1]) if i else 0), int(edge[i])
            agree = whole[:left] == alone[:left].tolist() and whole[len(whole) - (len(alone) - right) :] == alone[right:].tolist()
            if agree or (a == lo and b == hi - 1):
                got = whole[left : len(whole) - (len(alone) - right)]
            else:
                reach *= 2
                a, b = max(lo, word - reach), min(hi - 1, word + reach)
                text = body[starts[a] : ends[b]].tobytes()
        seen[mark] = got
        ids += got
        size[k] = len(got)
    return np.asarray(ids, np.uint32), size


def _encoded(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    coder = encoder(public_tokenizer(name))
    for batch in batches:
        body, offsets = text_buffers(batch["text"])
        for a, b in slices(offsets, BATCH_BYTES):
            yield batch.slice(a, b - a), *encode_chunked(coder, body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and ids array<int> of every row; null texts are empty, repeated rows are encoded alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, ends in _encoded(batches, tokenizer):
            made = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], made], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and text of rows of ids, special tokens included; null ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(public_tokenizer(tokenizer))
        for batch in batches:
            texts = [coder.decode(x or [], skip_special_tokens=False) for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them, a row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, ends in _encoded(batches, tokenizer):
            coder = encoder(public_tokenizer(tokenizer)).tokenizer
            of_ids, of_text = [], []
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                of_ids.append(hashlib.sha256(ids[a:b].astype("<u4").tobytes()).hexdigest())
                text = coder.decode(ids[a:b].tolist(), skip_special_tokens=False)
                of_text.append(hashlib.sha256(text.encode()).hexdigest())
            columns = [batch["doc_id"], pa.array(np.diff(ends)), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


@query("op2_bpe_encoding")
def op2_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded by shared chunks and decoded again."""
    return round_trip(read(spark, sf_dir, "documents"), "word_bpe_49k.json")
