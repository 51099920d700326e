"""Removal of repeated byte strings with a run-length compressed index.

What has to be compared is narrowed in two exact steps. Each string of WIDTH bytes has an anchor, the K-gram
of least hash in it; neighbouring strings mostly share it and form a span, which goes with the bytes that
its strings cover, its piece. Equal strings have equal anchors. A piece that an earlier document has is
repeated as a whole. Only where different pieces share an anchor and the bytes around it that all strings
of one of four ranges hold do the pieces themselves go to the bucket of the anchor.

An anchor with many different pieces, at the edge of a passage that stands in very many documents, would make
one bucket grow without bound. Such an anchor's pieces are dealt by their own names, and its strings, instead
of going to one index, by theirs, the least document of each string in a batch first.

A bucket builds indexes of its different pieces, the pieces of an anchor in one of them: the Burrows-Wheeler transform in runs, with suffix samples
at the ends of runs, and for each range of suffixes that share WIDTH bytes the least document. Pieces are
streamed over it backwards, many at a time: a step follows the run's mapping while bytes match, and
jumps to the nearest run of the wanted byte otherwise, cutting the matched length down to what the
sample there agrees with. Where the matching length reaches WIDTH, the range's least document decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablemill.llm.common import mix, partitions, powers, process_cache, read, slices, stage_and_free, text_buffers
from tablemill.llm.queries import query
from tablemill.llm.substring_dedup import common_above

WIDTH = 50
K = 16
#: Least and most bytes that a string has left of its anchor, by range: every string is in one range, and all strings of a
#: range hold `least` bytes left of the anchor and WIDTH - K - `most` right of it.
RANGES = ((26, 34), (17, 25), (9, 16), (0, 8))
#: Mean length of a phrase in bytes.
PHRASE = 128
SPREAD = 4
#: Bytes of text whose spans are sent together.
BATCH_BYTES = 16 << 20
#: Pieces that are sent together, about.
SENT_PIECES = 20_000
#: Bytes of text scanned for spans at once, so that the scan's arrays stay in a core's cache; a longer document is scanned alone.
SCAN_BYTES = 256 << 10
#: Bytes of pieces in one index, or all pieces of one anchor if they are more.
INDEX_BYTES = 512 << 10
#: Different pieces of one anchor that may meet in a task, over all batches.
ANCHOR_PIECES = 200_000
NULL_KEY = -(1 << 63)
#: Bits of positions that ride beside hashes; what is longer is scanned in parts that overlap.
PLACE = 28


def gram_hashes(body: np.ndarray) -> np.ndarray:
    """A hash of each K bytes."""
    value, width, weight = body.astype(np.uint64) + np.uint64(1), 1, 0xA24BAED4963EE407
    while width < K:
        value = value[:-width] * np.uint64(weight) + value[width:]
        width, weight = 2 * width, weight * weight % (1 << 64)
    value *= np.uint64(0x9FB21C651E98DF25)
    value ^= value >> np.uint64(29)
    value *= np.uint64(0xD6E8FEB86659FD93)
    return value


def sliding_least(value: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours."""
    have = 1
    while 2 * have <= width:
        value = np.minimum(value[:-have], value[have:])
        have *= 2
    rest = width - have
    return np.minimum(value[: len(value) - rest], value[rest:]) if rest else value


def least_places(value: np.ndarray, width: int) -> np.ndarray:
    """Where the least of each `width` neighbours stands, by its upper 64 - PLACE bits; the first of equal ones."""
    step = (1 << PLACE) - width + 1
    out = []
    for low in range(0, len(value) - width + 1, step):
        part = value[low : low + step + width - 1]
        tagged = part >> np.uint64(PLACE) << np.uint64(PLACE) | np.arange(len(part), dtype=np.uint64)
        out.append((sliding_least(tagged, width) & np.uint64((1 << PLACE) - 1)).astype(np.int64) + low)
    return np.concatenate(out)


class Spans:
    """Runs of strings that share an anchor, in the documents of a slice."""

    def __init__(self, body: np.ndarray, offsets: np.ndarray):
        n = len(body)
        self.start = self.count = self.home = self.place = np.empty(0, np.int64)
        self.anchor = self.piece = self.total = self.inverse = np.empty(0, np.uint64)
        if n < WIDTH:
            return
        grams = gram_hashes(body)
        at = least_places(grams, WIDTH - K + 1)
        strings = np.maximum(0, np.diff(offsets) - WIDTH + 1)
        held = strings > 0
        inside = np.zeros(len(at) + 1, np.int8)
        np.add.at(inside, offsets[:-1][held], 1)
        np.add.at(inside, offsets[:-1][held] + strings[held], -1)
        inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
        edge = inside.copy()
        edge[1:] &= (at[1:] != at[:-1]) | ~inside[:-1]
        self.start = np.flatnonzero(edge)
        self.home = np.searchsorted(offsets, self.start, "right") - 1
        # A span ends where the next starts or its document's strings do.
        self.count = np.minimum(np.append(self.start[1:], n), (offsets[:-1] + strings)[self.home]) - self.start
        self.place = place = at[self.start]
        self.anchor = grams[place]
        self.total, self.inverse = _running(body), _powers(pow(_BASE, -1, 1 << 64), n)
        self.piece = self.prints(self.start, self.start + self.count + WIDTH - 1)

    def prints(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """64-bit fingerprints of the bytes from low to high; ranges may overlap."""
        return mix((self.total[high] - self.total[low]) * self.inverse[low] ^ (high - low).astype(np.uint64))

    def sides(self) -> list[np.ndarray]:
        """For each range 24 bits of what all its strings hold around the anchor; 0 if the span has no string of it."""
        most = self.place - self.start
        least, out = most - self.count + 1, []
        for low, high in RANGES:
            held = np.flatnonzero((most >= low) & (least <= high))
            place, side = self.place[held], np.zeros(len(most), np.uint32)
            side[held] = self.prints(place - low, place + (WIDTH - high)) % np.uint64((1 << 24) - 1) + np.uint64(1)
            out.append(side)
        return out

    def keys(self) -> np.ndarray:
        """A name of each span, decided by its piece alone."""
        return span_keys(self.anchor, self.piece)


def span_keys(anchor: np.ndarray, piece: np.ndarray) -> np.ndarray:
    return mix(mix(anchor) + piece)


_BASE = 0xB7E151628AED2A6B | 5


def _running(body: np.ndarray) -> np.ndarray:
    kept = process_cache("suffix values")
    if "values" not in kept:
        kept["values"] = np.random.default_rng(5).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    total = np.zeros(len(body) + 1, np.uint64)
    np.cumsum(kept["values"][body] * _powers(_BASE, len(body)), out=total[1:])
    return total


def _powers(base: int, n: int) -> np.ndarray:
    """`powers`, kept for as many as an ordinary scan needs."""
    if n > SCAN_BYTES:
        return powers(base, n)
    kept = process_cache("suffix powers")
    if len(kept.get(base, ())) < n:
        kept[base] = powers(base, SCAN_BYTES)
    return kept[base][:n]


_ROW = pa.schema([("bucket", pa.int32()), ("doc", pa.int64()), ("n", pa.int32()), ("body", pa.binary())])
_REPLY = pa.schema([("doc", pa.int64()), ("kind", pa.int32()), ("body", pa.binary())])
_REPLY_DDL = "doc long, kind int, body binary"
#: Kinds of answers: spans whose pieces an earlier document has, spans to be compared, strings found in comparing.
WHOLE, ASKED, STRINGS = 0, 1, 2
#: Spans of ordinary anchors, spans of common anchors, and notices that an anchor is common.
PLAIN, DEALT, NOTICE = 0, 1, 2
#: A span to be compared: a bit for each range of which another span may have the same strings, or COMMON if the anchor is.
_ASK = np.dtype([("key", "<u8"), ("sides", "u1")])
COMMON = 1 << len(RANGES)
#: The most and the least bytes left of the anchor, by the bits of an ask.
_MOST = np.array([max([high for k, (_, high) in enumerate(RANGES) if bits >> k & 1], default=0) for bits in range(COMMON)])
_LEAST = np.array([min([low for k, (low, _) in enumerate(RANGES) if bits >> k & 1], default=0) for bits in range(COMMON)])
#: Three bytes of a side are sent.
_SIDE = np.dtype(("u1", 3))
_COLUMNS = ["<u8", "<u8", *[_SIDE] * len(RANGES), "<i8", "u1"]


def _rows(rows: list[tuple], schema: pa.Schema) -> list[pa.Array]:
    return [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)]


def _send(batch: pa.RecordBatch, n_buckets: int, most: int) -> pa.RecordBatch:
    """A batch's spans by bucket, of equal ones the least document's, and answers to its later documents."""
    body, offsets = text_buffers(batch["text"])
    docs = batch["doc"].to_numpy(zero_copy_only=False)
    found = []
    for a, b in slices(offsets, SCAN_BYTES):
        got = Spans(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        found.append((got.anchor, got.piece, docs[a:b][got.home], *got.sides()))
    rows: list[tuple] = []
    if found:
        anchor, piece, doc, *sides = (np.concatenate(x) for x in zip(*found, strict=True))
        key = span_keys(anchor, piece)
        # Spans of one key are equal but for their documents.
        order = np.argsort(key)
        sorted_ = key[order]
        new = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if len(key) else np.empty(0, np.int64)
        least = np.empty(len(doc), np.int64)
        if len(new):
            least[order] = np.repeat(np.minimum.reduceat(doc[order], new), np.diff(np.append(new, len(key))))
        later = doc > least
        rows += [(d % n_buckets, d, 0, keys) for d, _, keys in _answers(doc[later], key[later], WHOLE)]
        first = np.sort(order[new])
        anchor, piece, doc, *sides = (x[first] for x in (anchor, piece, least, *sides))
        _, back, uses = np.unique(anchor, return_inverse=True, return_counts=True)
        common = np.flatnonzero(uses[back] > most)
        kind = np.zeros(len(doc), np.uint8)
        kind[common] = DEALT
        _, one = np.unique(anchor[common], return_index=True)
        noticed = common[one]
        target = np.where(kind == DEALT, piece, anchor & np.uint64((1 << 24) - 1))
        target = np.append(target, anchor[noticed] & np.uint64((1 << 24) - 1))
        anchor, piece, doc, *sides = (np.append(x, x[noticed]) for x in (anchor, piece, doc, *sides))
        kind = np.append(kind, np.full(len(noticed), NOTICE, np.uint8))
        columns = [anchor, piece, *(x.astype("<u4").view("u1").reshape(-1, 4)[:, :3] for x in sides), doc, kind]
        bucket = (target % np.uint64(n_buckets)).astype(np.int32)
        order = np.lexsort((doc, bucket))
        cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            mine = order[cuts[k] : cuts[k + 1]]
            # Column by column, so that what varies little is packed well.
            rows.append((k, None, len(mine), b"".join(c[mine].tobytes() for c in columns)))
    return pa.RecordBatch.from_arrays(_rows(rows, _ROW), schema=_ROW)


def _unpacked(table: pa.Table) -> list[np.ndarray]:
    columns: list[list[np.ndarray]] = [[np.empty(0, t)] for t in _COLUMNS]
    for n, raw in zip(table["n"].to_pylist(), table["body"].to_pylist(), strict=True):
        at = 0
        for column, t in zip(columns, _COLUMNS, strict=True):
            column.append(np.frombuffer(raw, t, n, at))
            at += n * np.dtype(t).itemsize
    whole = [np.concatenate(c) for c in columns]
    return [np.pad(c, ((0, 0), (0, 1))).view("<u4").ravel() if c.ndim > 1 else c for c in whole]


def _answers(doc: np.ndarray, key: np.ndarray, kind: int) -> list[tuple[int, int, bytes]]:
    order = np.argsort(doc, kind="stable")
    doc, key = doc[order], key[order]
    cuts = np.append(np.flatnonzero(np.append(True, np.diff(doc) != 0)), len(doc)) if len(doc) else [0]
    return [(int(doc[a]), kind, key[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _replies(doc: np.ndarray, key: np.ndarray, kind: int) -> pa.Table:
    """`_answers` as a table, without a Python object for each document: whole copies have one in every bucket."""
    order = np.argsort(doc, kind="stable")
    doc, key = doc[order], key[order]
    new = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.empty(0, np.int64)
    ends = np.append(new, len(doc)) * key.dtype.itemsize
    raw, batches = key.view(np.uint8), []
    for a, b in slices(ends, 1 << 30):
        at = (ends[a : b + 1] - ends[a]).astype(np.int32)
        body = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(at), pa.py_buffer(raw[ends[a] : ends[b]])])
        batches.append(pa.RecordBatch.from_arrays([pa.array(doc[new[a:b]]), pa.array(np.full(b - a, kind, np.int32)), body], schema=_REPLY))
    return pa.Table.from_batches(batches, schema=_REPLY)


def _judge(table: pa.Table) -> pa.Table:
    """Answers on the spans of a bucket; answers sent along pass."""
    passing = pa.compute.is_valid(table["doc"])
    ready = table.filter(passing)
    replies = [pa.Table.from_arrays([ready["doc"], pa.array(np.full(len(ready), WHOLE, np.int32)), ready["body"]], schema=_REPLY)]
    columns = _unpacked(table.filter(pa.compute.invert(passing)))
    anchor, piece, *sides, doc, kind = columns
    # Spans that were dealt here by their pieces have nothing to do with those that came by their anchors.
    order = np.lexsort((kind == DEALT, anchor))
    inner, dealt = anchor[order], kind[order] == DEALT
    same = (inner[1:] == inner[:-1]) & (dealt[1:] == dealt[:-1])
    shared = dealt.copy()
    shared[1:] |= same
    shared[:-1] |= same
    anchor, piece, doc, kind, *sides = (x[order[shared]] for x in (anchor, piece, doc, kind, *sides))
    if len(doc):
        dealt = kind == DEALT
        order = np.lexsort((doc, kind, piece, anchor, dealt))
        anchor, piece, doc, kind, dealt, *sides = (x[order] for x in (anchor, piece, doc, kind, dealt, *sides))
        group = np.append(True, (anchor[1:] != anchor[:-1]) | (dealt[1:] != dealt[:-1]))
        common = np.repeat(np.maximum.reduceat(kind, np.flatnonzero(group)) > PLAIN, np.diff(np.append(np.flatnonzero(group), len(group))))
        there = kind != NOTICE
        anchor, piece, doc, dealt, common, *sides = (x[there] for x in (anchor, piece, doc, dealt, common, *sides))
    if len(doc):
        own = np.append(True, (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1]) | (dealt[1:] != dealt[:-1]))
        later = doc > doc[own][np.cumsum(own) - 1]
        replies.append(_replies(doc[later], span_keys(anchor[later], piece[later]), WHOLE))
        # The least document of each different piece stands for it.
        anchor, piece, doc, common, *sides = (x[own] for x in (anchor, piece, doc, common, *sides))
        wanted = np.zeros(len(doc), np.int64)
        wanted[common] = COMMON
        for k, side in enumerate(sides):
            there = np.flatnonzero((side > 0) & ~common)
            # Two groups that meet under one name are asked for more than they need, no more.
            group = mix(anchor[there]) + side[there]
            order = np.argsort(group, kind="stable")
            there, group = there[order], group[order]
            new = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(there) else np.empty(0, np.int64)
            if len(new):
                differ = np.maximum.reduceat(doc[there], new) > np.minimum.reduceat(doc[there], new)
                wanted[there[np.repeat(differ, np.diff(np.append(new, len(there))))]] |= 1 << k
        asked = np.empty(len(doc), _ASK)
        asked["key"], asked["sides"] = span_keys(anchor, piece), wanted
        replies.append(_replies(doc[wanted > 0], asked[wanted > 0], ASKED))
    return pa.concat_tables(replies)


def suffix_order(text: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """Suffixes in order; text holds symbols from 1 to 256, and 0 after each piece. Equal ones stand by position."""
    n = len(text)
    left = np.flatnonzero(text == 0)[piece] - np.arange(n)
    # Symbols by their place in the alphabet that occurs, as many in a rank as fit beside a position.
    used = np.bincount(text, minlength=257) > 0
    used[0] = True
    symbol, width = (np.cumsum(used) - 1).astype(np.uint64)[text], int(used.sum() - 1).bit_length()
    bits, longest = int(n).bit_length(), int(left.max(initial=0))
    depth = max(1, (64 - bits) // max(1, width))
    padded = np.append(symbol, np.zeros(depth, np.uint64))
    rank, live = np.zeros(n, np.uint64), left > 0
    for k in range(depth):
        # What follows an end mark counts as nothing.
        rank = rank << np.uint64(width) | padded[k : k + n] * live
        live &= padded[k : k + n] > 0
    order, rank = _sorted(rank, width * depth)
    while depth < longest:
        at = np.minimum(np.arange(n) + depth, n - 1)
        second = np.where(depth < left, rank[at] + 1, 0).astype(np.uint64)
        order, rank = _sorted(rank.astype(np.uint64) << np.uint64(bits) | second, 2 * bits)
        depth *= 2
    return order


def _sorted(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions by key, then position, and the keys' dense ranks."""
    place = int(len(key)).bit_length()
    if bits + place <= 64:
        # Positions ride in the lower bits: sorting values is faster than sorting indexes.
        both = np.sort(key << np.uint64(place) | np.arange(len(key), dtype=np.uint64))
        order, key = (both & np.uint64((1 << place) - 1)).astype(np.int64), both >> np.uint64(place)
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.append(False, key[1:] != key[:-1]))
    return order, rank


class RunIndex:
    """Run-length compressed Burrows-Wheeler transform of pieces, with samples at run ends.

    `first_doc` is each piece's least document.
    """

    def __init__(self, pieces: list[bytes], first_doc: np.ndarray, width: int):
        self.width = width
        size = np.array([len(p) for p in pieces], np.int64)
        self.ends = np.cumsum(size + 1)
        text = np.zeros(int(self.ends[-1]), np.int64)
        flat = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64) + 1
        text[np.arange(len(flat)) + np.repeat(np.arange(len(size)), size)] = flat
        piece = np.repeat(np.arange(len(size)), size + 1)
        order = suffix_order(text, piece)
        n = len(text)
        last = np.where(order > 0, text[order - 1], 0)
        last[order == (self.ends - size - 1)[piece[order]]] = 0
        head = np.append(True, last[1:] != last[:-1])
        # The eight bytes from each place as a number, the first lowest, and how many bytes its piece has from there.
        self.eight = np.append(np.maximum(text - 1, 0).astype(np.uint64), np.zeros(width + 8, np.uint64))
        for k in (1, 2, 4):
            self.eight[:-k] |= self.eight[k:] << np.uint64(8 * k)
        self.left = np.append(self.ends[piece] - 1 - np.arange(n), np.zeros(width + 8, np.int64))
        self.run_start = np.flatnonzero(head)
        self.run_symbol = last[self.run_start]
        run_end = np.append(self.run_start[1:], n) - 1
        self.sample_first, self.sample_last = order[self.run_start], order[run_end]
        # Runs by symbol and place: their first row, and how many of their symbol stand before them.
        self.by_symbol = np.lexsort((self.run_start, self.run_symbol))
        length = (run_end - self.run_start + 1)[self.by_symbol]
        self.before = np.cumsum(length) - length
        self.sorted_key = self.run_symbol[self.by_symbol] * n + self.run_start[self.by_symbol]
        self.slot = np.empty(len(self.by_symbol), np.int64)
        self.slot[self.by_symbol] = np.arange(len(self.by_symbol))
        self.n = n
        # Rows of symbol 0 come first in the order of suffixes, as they do among the runs by symbol.
        whole = self.left[:n] >= width
        equal = self._agree(order[:-1], order[1:], np.full(n - 1, width)) >= width
        self.range_start = np.flatnonzero(np.append(True, ~equal))
        doc = np.where(whole[order], first_doc[piece[order]], np.iinfo(np.int64).max)
        self.range_doc = np.minimum.reduceat(doc, self.range_start)
        # The row of each piece's end mark: among the marks, by position.
        self.end_row = np.arange(len(size))

    def _agree(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Common prefix of suffixes, at most `most` and `width` bytes."""
        most = np.minimum(np.minimum(most, self.width), np.minimum(self.left[a], self.left[b]))
        got, live = most.copy(), np.flatnonzero(most > 0)
        for k in range(0, self.width, 8):
            differ = self.eight[a[live] + k] ^ self.eight[b[live] + k]
            odd = differ != 0
            if odd.any():
                # Lowest set bit: the bytes below it are equal.
                first, off = differ[odd], live[odd]
                got[off] = np.minimum(most[off], k + (np.bitwise_count((first & -first) - np.uint64(1)) >> 3))
                live = live[~odd]
            live = live[most[live] > k + 8]
            if not len(live):
                break
        return got

    def step(self, row: np.ndarray, place: np.ndarray, matched: np.ndarray, symbol: np.ndarray):
        """One symbol to the left: new rows, the suffixes they stand for, and matched lengths."""
        run = np.searchsorted(self.run_start, row, "right") - 1
        off = np.flatnonzero(self.run_symbol[run] != symbol)
        if len(off):
            row, place, matched = row.copy(), place.copy(), matched.copy()
            key = symbol[off] * self.n + row[off]
            after = np.searchsorted(self.sorted_key, key)
            known = self.by_symbol[np.minimum(after, len(self.by_symbol) - 1)]
            prior = self.by_symbol[np.maximum(after - 1, 0)]
            has_after = (after < len(self.by_symbol)) & (self.run_symbol[known] == symbol[off])
            has_prior = (after > 0) & (self.run_symbol[prior] == symbol[off])
            down = np.where(has_after, self._agree(place[off], self.sample_first[known], matched[off]), -1)
            up = np.where(has_prior, self._agree(place[off], self.sample_last[prior], matched[off]), -1)
            use_up = up > down
            run[off] = np.where(use_up, prior, known)
            row[off] = np.where(use_up, np.append(self.run_start, self.n)[prior + 1] - 1, self.run_start[known])
            place[off] = np.where(use_up, self.sample_last[prior], self.sample_first[known])
            # A symbol that isn't there at all: start again at an end mark, with nothing matched.
            matched[off] = np.maximum(up, down)
        lost = matched < 0
        new_row = self.before[self.slot[run]] + row - self.run_start[run]
        return np.where(lost, 0, new_row), np.where(lost, self.ends[0] - 1, place - 1), np.where(lost, 0, matched + 1)

    def stream(self, patterns: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For every byte of the patterns, end to end: the capped matching length from it, and the least document."""
        size = np.array([len(p) for p in patterns], np.int64)
        start = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(patterns), np.uint8).astype(np.int64) + 1
        length, doc = np.zeros(len(flat), np.int64), np.full(len(flat), np.iinfo(np.int64).max)
        row = np.zeros(len(size), np.int64)
        place = np.full(len(size), self.ends[0] - 1)
        matched = np.zeros(len(size), np.int64)
        live = np.flatnonzero(size > 0)
        for k in range(int(size.max(initial=0))):
            live = live[k < size[live]]
            at = start[live] + size[live] - 1 - k
            row[live], place[live], matched[live] = self.step(row[live], place[live], matched[live], flat[at])
            length[at] = matched[live]
            full = matched[live] >= self.width
            which = np.searchsorted(self.range_start, row[live][full], "right") - 1
            doc[at[full]] = self.range_doc[which]
        return length, doc


_STRING = np.dtype([("print", "<u8"), ("doc", "<i8"), ("key", "<u8"), ("first", "<u2")])
#: In place of a piece's shift: strings of common anchors, and marks that are ready.
PACKED, READY = -1, -2
#: `part` is the same for all pieces of an anchor, and seldom for those of two.
_PIECE = pa.schema(
    [("bucket", pa.int32()), ("part", pa.int32()), ("doc", pa.int64()), ("key", pa.int64()), ("shift", pa.int32()), ("piece", pa.binary())]
)
_PIECE_DDL = "bucket int, part int, doc long, key long, shift int, piece binary"


def _later_strings(strings: np.ndarray) -> np.ndarray:
    """Which strings a smaller document has too."""
    order = np.lexsort((strings["doc"], strings["print"]))
    sorted_ = strings[order]
    new = np.append(True, sorted_["print"][1:] != sorted_["print"][:-1]) if len(order) else np.empty(0, bool)
    later = np.zeros(len(order), bool)
    later[order] = sorted_["doc"] > sorted_["doc"][new][np.cumsum(new) - 1]
    return later


def _single_marks(strings: np.ndarray) -> list[tuple[int, int, bytes]]:
    mark = np.empty(len(strings), _MARK)
    mark["key"], mark["first"], mark["count"] = strings["key"], strings["first"], 1
    return _answers(strings["doc"], mark, STRINGS)


def _strings(got: Spans, chosen: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The strings of spans with common anchors."""
    size = got.count[chosen]
    of = np.repeat(chosen, size)
    first = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
    strings = np.empty(len(of), _STRING)
    begin = got.start[of] + first
    strings["print"] = got.prints(begin, begin + WIDTH)
    strings["doc"], strings["key"], strings["first"] = docs[got.home[of]], got.keys()[of], first
    return strings


def _dealt(strings: np.ndarray, n_buckets: int) -> pa.RecordBatch:
    """A batch's strings by bucket, and marks for those that it has in a smaller document."""
    later = _later_strings(strings)
    rows = [(doc % n_buckets, 0, doc, 0, READY, mark) for doc, _, mark in _single_marks(strings[later])]
    strings = strings[~later]
    bucket = (strings["print"] % np.uint64(n_buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    rows += [(k, 0, None, 0, PACKED, strings[order[cuts[k] : cuts[k + 1]]].tobytes()) for k in np.flatnonzero(np.diff(cuts)).tolist()]
    return pa.RecordBatch.from_arrays(_rows(rows, _PIECE), schema=_PIECE)


def _compare_bucket(table: pa.Table) -> pa.Table:
    """Marks for what came to a bucket: pieces, packed strings, and marks that are ready."""
    shift = table["shift"].to_numpy()
    bodies = table["piece"].to_pylist()
    ready = table.filter(pa.array(shift == READY))
    rows = [(d, STRINGS, mark) for d, mark in zip(ready["doc"].to_pylist(), ready["piece"].to_pylist(), strict=True)]
    strings = np.frombuffer(b"".join(bodies[i] for i in np.flatnonzero(shift == PACKED).tolist()), _STRING)
    rows += _single_marks(strings[_later_strings(strings)])
    made = pa.Table.from_arrays(_rows(rows, _REPLY), schema=_REPLY)
    pieces = table.filter(pa.array(shift >= 0))
    return pa.concat_tables([made, _compare(pieces)]) if len(pieces) else made


def _compare(table: pa.Table) -> pa.Table:
    """Strings of a bucket's pieces that an earlier document's piece has: (key, first string, strings)."""
    table = table.take(pa.array(np.argsort(table["part"].to_numpy(), kind="stable")))
    part, doc, shift = (table[c].to_numpy() for c in ("part", "doc", "shift"))
    key, pieces = table["key"].to_numpy().view(np.uint64), table["piece"].to_pylist()
    homes, marks = [np.empty(0, np.int64)], [np.empty(0, _MARK)]
    for low, high in _indexed(part, np.array([len(p) for p in pieces], np.int64)):
        of, first, count = _repeated(pieces[low:high], doc[low:high])
        mark = np.empty(len(of), _MARK)
        mark["key"], mark["first"], mark["count"] = key[low:high][of], first + shift[low:high][of], count
        homes.append(doc[low:high][of])
        marks.append(mark)
    return _replies(np.concatenate(homes), np.concatenate(marks), STRINGS)


def _indexed(part: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of sorted pieces of at most INDEX_BYTES together, or of one part; no part is cut."""
    new = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
    ends = np.append(0, np.cumsum(size))[new]
    for a, b in slices(ends, INDEX_BYTES):
        yield int(new[a]), int(new[b])


def _repeated(pieces: list[bytes], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings that an earlier document's piece has: their pieces, first strings and lengths."""
    least: dict[bytes, int] = {}
    for piece, d in zip(pieces, doc.tolist(), strict=True):
        least[piece] = min(d, least.get(piece, d))
    index = RunIndex(list(least), np.array(list(least.values()), np.int64), WIDTH)
    length, first = index.stream(pieces)
    size = np.array([len(p) for p in pieces], np.int64)
    of = np.repeat(np.arange(len(size)), size)
    hit = np.flatnonzero((length >= WIDTH) & (first < doc[of]))
    new = np.append(True, (np.diff(hit) != 1) | (np.diff(of[hit]) != 0)) if len(hit) else np.empty(0, bool)
    begin = hit[new]
    count = np.diff(np.append(np.flatnonzero(new), len(hit)))
    return of[begin], begin - (np.cumsum(size) - size)[of[begin]], count


_MARK = np.dtype([("key", "<u8"), ("first", "<u2"), ("count", "<u2")])


def _keyed(docs: DataFrame, extra: list | None = None) -> DataFrame:
    return docs.select(*(extra or []), F.coalesce("doc_id", F.lit(NULL_KEY)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))


#: Tells equal names in different documents of a slice apart.
SALT = np.uint64(0x9E3779B97F4A7C15)


def _told(bodies: list, kind) -> tuple[np.ndarray, np.ndarray]:
    """What the documents of a slice are told, end to end, and to which document."""
    told = [b"".join(b or []) for b in bodies]
    home = np.repeat(np.arange(len(told), dtype=np.uint64), [len(x) // np.dtype(kind).itemsize for x in told])
    return np.frombuffer(b"".join(told), kind), home


def _cut(batch: pa.RecordBatch, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """The asked pieces of a batch's documents, trimmed to the ranges asked for, and the strings of common anchors."""
    body, offsets = text_buffers(batch["text"])
    docs = batch["doc"].to_numpy(zero_copy_only=False)
    asked_of = batch["asked"].to_pylist()
    dealt: list[np.ndarray] = []
    columns: list[tuple] = []
    for a, b in slices(offsets, SCAN_BYTES):
        low = int(offsets[a])
        got = Spans(body[low : offsets[b]], offsets[a : b + 1] - low)
        name = got.keys() + got.home.astype(np.uint64) * SALT
        _, once = np.unique(name, return_index=True)
        asks, home = _told(asked_of[a:b], _ASK)
        asked, first = np.unique(asks["key"] + home * SALT, return_index=True)
        at = np.minimum(np.searchsorted(asked, name[once]), max(0, len(asked) - 1))
        hit = asked[at] == name[once] if len(asked) else np.zeros(len(once), bool)
        chosen, sides = once[hit], asks["sides"][first][at[hit]]
        common = chosen[sides >= COMMON]
        if len(common):
            dealt.append(_strings(got, common, docs[a:b]))
        chosen, sides = chosen[sides < COMMON], sides[sides < COMMON]
        # Strings outside the ranges asked for are in no other piece.
        most = got.place[chosen] - got.start[chosen]
        least = np.maximum(most - got.count[chosen] + 1, _LEAST[sides])
        begin = got.place[chosen] - np.minimum(most, _MOST[sides])
        anchor = mix(got.anchor[chosen] >> np.uint64(24))
        columns.append((
            (anchor % np.uint64(n_buckets)).astype(np.int32), (anchor // np.uint64(n_buckets)).astype(np.int32), docs[a:b][got.home[chosen]],
            got.keys()[chosen].view(np.int64), (begin - got.start[chosen]).astype(np.int32), begin + low, got.place[chosen] - least + WIDTH + low,
        ))
        if sum(len(c[0]) for c in columns) >= SENT_PIECES:
            yield _pieces(body, columns)
            columns = []
    if columns:
        yield _pieces(body, columns)
    if dealt:
        yield _dealt(np.concatenate(dealt), n_buckets)


def _pieces(body: np.ndarray, columns: list[tuple]) -> pa.RecordBatch:
    *named, begin, end = (np.concatenate(c) for c in zip(*columns, strict=True))
    piece = [body[i:j].tobytes() for i, j in zip(begin.tolist(), end.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([*(pa.array(c) for c in named), pa.array(piece, pa.binary())], schema=_PIECE)


def repeated_strings(docs: DataFrame) -> DataFrame:
    """doc, answers: what repeats in each document, as names of spans and of strings in them."""
    n_partitions = partitions(docs.sparkSession)
    n_buckets, most = SPREAD * n_partitions, common_above(ANCHOR_PIECES, n_partitions)
    keyed = _keyed(docs)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = text_buffers(batch["text"])
            for a, b in slices(offsets, BATCH_BYTES):
                yield _send(batch.slice(a, b - a), n_buckets, most)

    def judge(table: pa.Table) -> pa.Table:
        return _judge(table)

    sent = keyed.mapInArrow(send, "bucket int, doc long, n int, body binary")
    # A bucket takes long for its bytes: tasks aren't put together by their size.
    answers = stage_and_free(sent.repartition(n_partitions, "bucket").groupBy("bucket").applyInArrow(judge, _REPLY_DDL))
    asked = answers.where(F.col("kind") == ASKED).groupBy("doc").agg(F.collect_list("body").alias("asked"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _cut(batch, n_buckets)

    def compare(table: pa.Table) -> pa.Table:
        return _compare_bucket(table)

    pieces = keyed.join(asked, "doc").select("doc", "text", "asked").mapInArrow(cut, _PIECE_DDL)
    strings = stage_and_free(pieces.repartition(n_partitions, "bucket").groupBy("bucket").applyInArrow(compare, _REPLY_DDL))
    every = answers.where(F.col("kind") == WHOLE).unionByName(strings)
    return every.groupBy("doc").agg(F.collect_list(F.struct("kind", "body")).alias("answers"))


def _answered(answers: pa.ListArray, which: int, kind) -> tuple[np.ndarray, np.ndarray]:
    """What answers of one kind tell the documents of a slice, end to end, and to which document."""
    lengths = pa.compute.fill_null(pa.compute.list_value_length(answers), 0).to_numpy()
    flat, kind = answers.flatten(), np.dtype(kind)
    chosen = np.flatnonzero(flat.field("kind").to_numpy() == which)
    bodies = flat.field("body").take(pa.array(chosen)).cast(pa.large_binary())
    if not len(chosen):
        return np.empty(0, kind), np.empty(0, np.uint64)
    _, at, data = bodies.buffers()
    ends = np.frombuffer(at, np.int64)[bodies.offset : bodies.offset + len(bodies) + 1]
    home = np.repeat(np.arange(len(answers), dtype=np.uint64), lengths)[chosen]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind), np.repeat(home, np.diff(ends) // kind.itemsize)


def removed_ranges(body: np.ndarray, offsets: np.ndarray, answers: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Where removed runs start and end in the bytes of a slice's documents."""
    change = np.zeros(len(body) + 1, np.int32)
    if len(answers.flatten()):
        got = Spans(body, offsets)
        name = got.keys() + got.home.astype(np.uint64) * SALT
        order = np.argsort(name)
        name = name[order]
        key, home = _answered(answers, WHOLE, np.uint64)
        if len(key):
            wanted = np.sort(key + home * SALT)
            whole = order[wanted[np.minimum(np.searchsorted(wanted, name), len(wanted) - 1)] == name]
            np.add.at(change, got.start[whole], 1)
            np.add.at(change, (got.start + got.count)[whole] + WIDTH - 1, -1)
        mark, of = _answered(answers, STRINGS, _MARK)
        if len(mark):
            wanted = mark["key"] + of * SALT
            first, last = np.searchsorted(name, wanted), np.searchsorted(name, wanted, "right")
            # A piece may stand in a document several times.
            for turn in range(int((last - first).max())):
                here = np.flatnonzero(first + turn < last)
                begin = got.start[order[first[here] + turn]] + mark["first"][here]
                np.add.at(change, begin, 1)
                np.add.at(change, begin + mark["count"][here].astype(np.int64) + WIDTH - 1, -1)
    gone = np.zeros(len(body) + 2, np.int8)
    gone[1:-1] = np.cumsum(change[:-1]) > 0
    turn = np.diff(gone)
    starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    # Runs of two documents that touch are two.
    cut = np.unique(offsets[1:-1])
    if len(starts):
        within = np.searchsorted(starts, cut, "right") - 1
        cut = cut[(within >= 0) & (starts[within] < cut) & (cut < ends[within])]
    else:
        cut = cut[:0]
    return np.sort(np.append(starts, cut)), np.sort(np.append(ends, cut))


def remove_strings(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """`columns` of `docs`, or all, with n_bytes, n_removed, n_spans and kept (the remaining bytes, binary).

    A byte goes if a WIDTH-byte string over it also starts in a document with a smaller doc_id. Null texts are
    empty; a null doc_id counts as smallest; rows with one doc_id are no smaller than each other, so that
    repeated rows get equal results. A removed run may leave broken characters behind.
    """
    added = ("n_bytes", "n_removed", "n_spans", "kept")
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added])
    carried = [c for c in base.columns if columns is None or c in columns]
    row = F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row")
    packed = _keyed(base, [row])
    joined = packed.join(repeated_strings(base), "doc", "left").select("row", "text", "answers")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = text_buffers(batch["text"])
            for a, b in slices(offsets, SCAN_BYTES):
                low = int(offsets[a])
                own = offsets[a : b + 1] - low
                part = body[low : offsets[b]]
                starts, ends = removed_ranges(part, own, batch["answers"].slice(a, b - a))
                raw, kept = part.tobytes(), []
                at = np.searchsorted(starts, own)
                n_removed = np.zeros(b - a, np.int64)
                for k in range(b - a):
                    left, pieces = int(own[k]), []
                    for i, j in zip(starts[at[k] : at[k + 1]].tolist(), ends[at[k] : at[k + 1]].tolist(), strict=True):
                        pieces.append(raw[left:i])
                        n_removed[k] += j - i
                        left = j
                    pieces.append(raw[left : own[k + 1]])
                    kept.append(b"".join(pieces))
                yield pa.RecordBatch.from_arrays(
                    [batch["row"].slice(a, b - a), pa.array(np.diff(own)), pa.array(n_removed), pa.array(np.diff(at)), pa.array(kept, pa.binary())],
                    ["row", *added],
                )

    schema = f"row {packed.schema['row'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary"
    return joined.mapInArrow(cut, schema).select("row.*", *added)


@query("op10_suffix_array_dedup")
def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes of earlier documents removed from all documents."""
    done = remove_strings(read(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
