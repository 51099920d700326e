"""Removal of repeated word windows, found by recompression.

Every document's words are parsed in rounds. A round first gives each maximal run of a symbol one name, then
splits all symbols into left and right ones by a bit of their names and gives each pair of a left
symbol and a right one after it one name. Names are fingerprints of what they stand for, so they are the
same in all documents without any exchange, and equal substrings get equal symbols in their
interior. With each symbol goes its context: the words that, wherever they stand, force this symbol.

A window of WINDOW words is assigned to its anchor: of the highest symbols whose
contexts lie inside the window, the one with the least hash, so that neighbouring windows mostly share it. Equal windows have equal anchors at equal distances, so windows can be
compared where their anchor's name sends them; windows that share one are told apart by a
fingerprint of their words. Batches first drop windows that they hold twice, so that a passage
that stands in every document is sent once per batch. At such a passage's edge, anchors get many different
windows; a batch in which an anchor has more than its share of ANCHOR_RUNS deals its windows by their own
names and only sends notice of it, upon which the windows that other batches sent to the anchor are dealt again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablemill.llm.common import mix, partitions, read, slices, stage_and_free, text_buffers, word_bounds, word_hashes
from tablemill.llm.queries import query

WINDOW = 20
#: Rounds of naming; contexts of later rounds don't fit in a window.
ROUNDS = 2
#: Buckets for each shuffle partition.
SPREAD = 2
#: Bytes of text whose windows are sent together.
BATCH_BYTES = 16 << 20
#: Runs of windows of one anchor that may meet in a task. There are about as many batches as shuffle partitions,
#: so an anchor is a common one in a batch if it has more than this number over theirs.
ANCHOR_RUNS = 200_000
NULL_KEY = -(1 << 63)
_FAR = np.int64(1 << 60)
_A, _B = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)


class Level:
    """Symbols in order: name, start and end word, context, whether they open a document."""

    def __init__(self, name, start, end, low, high, opens):
        self.name, self.start, self.end, self.low, self.high, self.opens = name, start, end, low, high, opens

    def runs(self) -> Level:
        first = np.ones(len(self.name), bool)
        first[1:] = (self.name[1:] != self.name[:-1]) | self.opens[1:]
        at = np.flatnonzero(first)
        last = np.append(at[1:], len(self.name)) - 1
        length = (last - at + 1).astype(np.uint64)
        name = np.where(length > 1, mix(self.name[at] * _A + length), self.name[at])
        # That a run is maximal is known from the symbols beside it.
        low = np.where(self.opens[at], -_FAR, self.low[np.maximum(at - 1, 0)])
        closes = np.append(self.opens[at[1:]], True)
        high = np.where(closes, _FAR, self.high[np.minimum(last + 1, len(self.name) - 1)])
        return Level(name, self.start[at], self.end[last], low, high, self.opens[at])

    def pairs(self, turn: int) -> Level:
        left = (mix(self.name + np.uint64(turn)) >> np.uint64(63)).astype(bool)
        joined = left[:-1] & ~left[1:] & ~self.opens[1:]
        second = np.append(False, joined)
        head = np.append(joined, False)
        name, end, low, high = self.name.copy(), self.end.copy(), self.low.copy(), self.high.copy()
        at = np.flatnonzero(head)
        name[at] = mix(self.name[at] * _A + self.name[at + 1] * _B + np.uint64(1))
        end[at], high[at] = self.end[at + 1], self.high[at + 1]
        # A left symbol stays alone because of the one after it, a right one because of the one before.
        alone = left & ~head
        closes = np.append(self.opens[1:], True)
        high[alone] = np.where(closes, _FAR, np.append(self.high[1:], _FAR))[alone]
        alone = ~left & ~second
        low[alone] = np.where(self.opens, -_FAR, np.append(-_FAR, self.low[:-1]))[alone]
        keep = ~second
        return Level(name[keep], self.start[keep], end[keep], low[keep], high[keep], self.opens[keep])


def levels(words: np.ndarray, opens: np.ndarray, rounds: int) -> list[Level]:
    at = np.arange(len(words), dtype=np.int64)
    now = Level(words, at, at + 1, at, at + 1, opens)
    found = [now]
    for turn in range(rounds):
        now = now.runs().pairs(turn + 1)
        found.append(now)
    return found


def window_prints(words: np.ndarray, width: int) -> np.ndarray:
    """64-bit fingerprints of all runs of `width` words."""
    if len(words) < width:
        return np.empty(0, np.uint64)
    base, out, done = 0x9E3779B97F4A7C15, None, 0
    piece, size = words, 1
    while True:
        if width & size:
            # out covers `done` words; the next piece stands behind them.
            out = piece.copy() if out is None else out[: len(piece) - done] * np.uint64(pow(base, size, 1 << 64)) + piece[done:]
            done += size
        if done == width:
            return mix(out[: len(words) - width + 1])
        piece = piece[:-size] * np.uint64(pow(base, size, 1 << 64)) + piece[size:]
        size *= 2


def _least(value: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Index of the first least value in each range [left, right), -1 for empty ranges."""
    best = np.where(left < right, left, -1)
    least = value[np.minimum(left, len(value) - 1)]
    open_ = np.flatnonzero(left + 1 < right)
    step = 1
    while len(open_):
        at = left[open_] + step
        less = value[at] < least[open_]
        better = open_[less]
        best[better], least[better] = at[less], value[at[less]]
        step += 1
        open_ = open_[left[open_] + step < right[open_]]
    return best


class Anchored:
    """Runs of consecutive windows that share an anchor."""

    def __init__(self, words: np.ndarray, firsts: np.ndarray, width: int):
        n = len(words)
        opens = np.zeros(n, bool)
        opens[firsts[:-1][firsts[:-1] < n]] = True
        prints = window_prints(words, width)
        room = np.zeros(n + 1, np.int64)
        size = np.diff(firsts)
        whole = size >= width
        np.add.at(room, firsts[:-1][whole], 1)
        np.add.at(room, firsts[1:][whole] - width + 1, -1)
        here = np.cumsum(room[:-1]) > 0
        window = np.flatnonzero(here)
        symbol = np.full(len(window), -1, np.int64)
        key = np.zeros(len(window), np.uint64)
        shift = np.zeros(len(window), np.int64)
        wanted = np.ones(len(window), bool)
        parsed = levels(words, opens, ROUNDS)
        for number in range(len(parsed) - 1, -1, -1):
            level = parsed[number]
            sure = (level.low >= 0) & (level.high < _FAR)
            low, high, start, name = level.low[sure], level.high[sure], level.start[sure], level.name[sure]
            if not len(low):
                continue
            # The symbols whose contexts lie in a window stand together: from `left`, before `right`.
            asked = window[wanted]
            left = np.concatenate(([0], np.cumsum(np.bincount(low, minlength=n + 1))))[asked]
            right = np.cumsum(np.bincount(high, minlength=n + 1))[asked + width]
            chosen = _least(mix(name), left, right)
            fits = np.zeros(len(window), bool)
            fits[np.flatnonzero(wanted)[chosen >= 0]] = True
            chosen = chosen[chosen >= 0]
            symbol[fits] = chosen * 8 + number
            key[fits] = name[chosen] + np.uint64(number)
            shift[fits] = start[chosen] - window[fits]
            wanted &= ~fits
            if not wanted.any():
                break
        new = np.ones(len(window), bool)
        new[1:] = (symbol[1:] != symbol[:-1]) | (np.diff(window) != 1)
        self.at = np.flatnonzero(new)
        self.first = window[self.at]
        self.count = np.diff(np.append(self.at, len(window)))
        self.key = mix(key[self.at])
        self.shift = shift[self.at].astype(np.uint8)
        self.print = prints[window] if len(window) else np.empty(0, np.uint64)
        self.home = np.searchsorted(firsts, self.first, "right") - 1

    def identity(self) -> np.ndarray:
        """A fingerprint of the anchor, the shift and all window fingerprints of a run."""
        if not len(self.at):
            return np.empty(0, np.uint64)
        step = np.arange(len(self.print)) - np.repeat(self.at, self.count)
        return mix(self.key ^ mix(np.add.reduceat(mix(self.print + step.astype(np.uint64) * _A), self.at) + self.shift))


_ENTRY = np.dtype([("key", "<u4"), ("more", "u1"), ("shift", "u1"), ("count", "u1"), ("pos", "<u4"), ("variant", "<i8"), ("doc", "<i8")])
_MARK = np.dtype([("pos", "<u4"), ("count", "u1")])
_STRING = np.dtype([("name", "<u8"), ("doc", "<i8"), ("pos", "<u4"), ("variant", "<i8")])
#: In place of a number of entries: windows that were dealt by their names.
DEALT = -1


def _later(identity: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Which items have an equal one at a smaller (doc, pos)."""
    rank = np.lexsort((pos, doc, identity))
    new = np.ones(len(rank), bool)
    new[1:] = identity[rank][1:] != identity[rank][:-1]
    first = rank[np.flatnonzero(new)][np.cumsum(new) - 1] if len(rank) else rank
    out = np.zeros(len(identity), bool)
    out[rank] = (doc[rank] != doc[first]) | (pos[rank] != pos[first])
    return out


def _marks(doc: np.ndarray, variant: np.ndarray, pos: np.ndarray, count: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Marks of each document as bytes."""
    order = np.lexsort((pos, variant, doc))
    doc, variant = doc[order], variant[order]
    body = np.empty(len(order), _MARK)
    body["pos"], body["count"] = pos[order], count[order]
    new = np.flatnonzero(np.append(True, (np.diff(doc) != 0) | (variant[1:] != variant[:-1]))) if len(doc) else []
    for a, b in zip(new, np.append(new[1:], len(doc)) if len(doc) else [], strict=True):
        yield int(doc[a]), int(variant[a]), body[a:b].tobytes()


def _has_copies(doc: np.ndarray) -> bool:
    return len(np.unique(doc)) < len(doc)


_SENT = pa.schema([("bucket", pa.int32()), ("doc", pa.int64()), ("variant", pa.int64()), ("body", pa.binary())])
_SENT_DDL = "bucket int, doc long, variant long, body binary"


def common_above(allowed: int, n_partitions: int) -> int:
    """Runs of one anchor in a batch that still go to the anchor's bucket."""
    return max(2, allowed // n_partitions)


def _send(batch: pa.RecordBatch, n_buckets: int, width: int, most: int) -> pa.RecordBatch:
    """A batch's window runs by bucket, and marks for runs that the batch itself has earlier."""
    body, offsets = text_buffers(batch["text"])
    doc = batch["doc"].to_numpy(zero_copy_only=False)
    variant = batch["variant"].to_numpy(zero_copy_only=False)
    entries, prints, identities = [], [], []
    for a, b in slices(offsets):
        part, off = body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, _, firsts = word_bounds(part, off)
        if len(starts) < width:
            continue
        found = Anchored(word_hashes(part, starts, 1), firsts, width)
        entry = np.empty(len(found.at), _ENTRY)
        entry["key"] = (found.key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        entry["more"] = (found.key >> np.uint64(32) & np.uint64(255)).astype(np.uint8)
        entry["shift"], entry["count"] = found.shift, found.count
        entry["pos"] = found.first - firsts[found.home]
        entry["variant"], entry["doc"] = variant[a:b][found.home], doc[a:b][found.home]
        entries.append((entry, found.key >> np.uint64(40)))
        prints.append(found.print)
        identities.append(found.identity())
    rows: list[tuple] = []
    if entries:
        entry, bucket = (np.concatenate(x) for x in zip(*entries, strict=True))
        bucket = (bucket % np.uint64(n_buckets)).astype(np.int32)
        print_ = np.concatenate(prints)
        at = np.cumsum(entry["count"], dtype=np.int64) - entry["count"]
        identity = np.concatenate(identities)
        again = _later(identity, entry["doc"], entry["pos"])
        gone = entry[again]
        for d, v, marks in _marks(gone["doc"], gone["variant"], gone["pos"], gone["count"]):
            rows.append((d % n_buckets, d, v, marks))
        kept = np.flatnonzero(~again)
        # Of repeated rows one is enough.
        whole = np.rec.fromarrays([identity[kept], entry["doc"][kept], entry["pos"][kept], entry["variant"][kept]])
        kept = kept[np.unique(whole, return_index=True)[1]] if _has_copies(doc) else kept
        # Common anchors: their windows one by one, and a run without windows as notice.
        anchor = entry["key"].astype(np.uint64) | entry["more"].astype(np.uint64) << np.uint64(32)
        _, one, back, uses = np.unique(anchor[kept], return_index=True, return_inverse=True, return_counts=True)
        common = uses[back] > most
        if common.any():
            dealt = _windows(entry, print_, at, kept[common])
            rows += _dealt(dealt, n_buckets)
            notice = kept[one[uses > most]]
            kept = np.append(kept[~common], np.arange(len(notice)) + len(entry))
            entry, bucket, at = np.append(entry, entry[notice]), np.append(bucket, bucket[notice]), np.append(at, at[notice])
            entry["count"][len(entry) - len(notice) :] = 0
        kept = kept[np.argsort(bucket[kept], kind="stable")]
        cuts = np.searchsorted(bucket[kept], np.arange(n_buckets + 1))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            mine = kept[cuts[k] : cuts[k + 1]]
            own = print_[_spread(at[mine], entry["count"][mine].astype(np.int64))]
            # Column by column, so that what varies little is packed well.
            columns = [entry[name][mine].tobytes() for name in _ENTRY.names]
            rows.append((k, None, len(mine), b"".join(columns) + own.tobytes()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_SENT)], schema=_SENT)


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indexes start .. start + size - 1 of all runs, end to end."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


def _windows(entry: np.ndarray, prints: np.ndarray, at: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The windows of some runs, named by anchor, distance from it and fingerprint."""
    size = entry["count"][chosen].astype(np.int64)
    run = np.repeat(chosen, size)
    step = _spread(np.zeros(len(size), np.int64), size)
    anchor = entry["key"][run].astype(np.uint64) | entry["more"][run].astype(np.uint64) << np.uint64(32)
    # The anchor's distance from the window's start, which falls by one from window to window.
    away = (entry["shift"].astype(np.int64)[run] - step).astype(np.uint64)
    out = np.empty(len(run), _STRING)
    out["name"] = mix(mix(anchor | away << np.uint64(40)) + prints[_spread(at[chosen], size)])
    out["doc"], out["variant"], out["pos"] = entry["doc"][run], entry["variant"][run], entry["pos"][run] + step
    return out


def _dealt(windows: np.ndarray, n_buckets: int) -> list[tuple]:
    bucket = (windows["name"] % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    return [(k, None, DEALT, windows[order[cuts[k] : cuts[k + 1]]].tobytes()) for k in np.flatnonzero(np.diff(cuts)).tolist()]


def _received(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    entries, prints = [np.empty(0, _ENTRY)], [np.empty(0, np.uint64)]
    for n, raw in zip(table["variant"].to_pylist(), table["body"].to_pylist(), strict=True):
        entry, at = np.empty(n, _ENTRY), 0
        for name in _ENTRY.names:
            kind = _ENTRY[name]
            entry[name] = np.frombuffer(raw, kind, n, at)
            at += n * kind.itemsize
        entries.append(entry)
        prints.append(np.frombuffer(raw, np.uint64, offset=at))
    return np.concatenate(entries), np.concatenate(prints)


def _later_windows(windows: np.ndarray) -> list[tuple]:
    """Marks for windows that have an equal one at a smaller place."""
    order = np.argsort(windows["name"], kind="stable")
    name = windows["name"][order]
    same = name[1:] == name[:-1]
    repeated = np.zeros(len(order), bool)
    repeated[1:] |= same
    repeated[:-1] |= same
    mine = windows[order[repeated]]
    mine = mine[_later(mine["name"], mine["doc"], mine["pos"])]
    # Consecutive windows of a document become one mark.
    mine = mine[np.lexsort((mine["pos"], mine["variant"], mine["doc"]))]
    new = np.ones(len(mine), bool)
    if len(mine):
        new[1:] = (np.diff(mine["pos"].astype(np.int64)) != 1) | (mine["doc"][1:] != mine["doc"][:-1]) | (mine["variant"][1:] != mine["variant"][:-1])
        # A mark counts in one byte.
        run = np.arange(len(mine)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        new |= run % 200 == 0
    first = mine[new]
    count = np.diff(np.append(np.flatnonzero(new), len(mine)))
    return list(_marks(first["doc"], first["variant"], first["pos"], count))


_JUDGED = pa.schema([("bucket", pa.int32()), ("doc", pa.int64()), ("variant", pa.int64()), ("body", pa.binary())])


def _judge(table: pa.Table, n_buckets: int) -> pa.Table:
    """Marks for a bucket's windows that have an equal earlier one, and windows to be dealt.

    Marks and dealt windows that came along pass.
    """
    ours = pa.compute.and_(pa.compute.is_null(table["doc"]), pa.compute.greater_equal(table["variant"], 0))
    entry, prints = _received(table.filter(ours))
    size = entry["count"].astype(np.int64)
    at = np.cumsum(size) - size
    anchor = entry["key"].astype(np.uint64) | entry["more"].astype(np.uint64) << np.uint64(32)
    noticed = np.isin(anchor, anchor[size == 0])
    rows = [(None, *mark) for mark in _later_windows(_windows(entry, prints, at, np.flatnonzero(~noticed)))]
    rows += _dealt(_windows(entry, prints, at, np.flatnonzero(noticed)), n_buckets)
    made = pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_JUDGED)], schema=_JUDGED)
    return pa.concat_tables([table.filter(pa.compute.invert(ours)).select(_JUDGED.names).cast(_JUDGED), made])


def _judge_dealt(table: pa.Table) -> pa.Table:
    windows = np.frombuffer(b"".join(table["body"].to_pylist()), _STRING)
    rows = _later_windows(windows)
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["doc", "variant", "body"])


def repeated_windows(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc, variant, marks: where windows start that also start earlier, per document.

    doc is doc_id (the smallest long for null), variant the text's 64-bit hash, which keeps apart different
    texts under one doc_id. Each mark's element is bytes of (first word, windows) entries.
    """
    n_partitions = partitions(docs.sparkSession)
    n_buckets, most = SPREAD * n_partitions, common_above(ANCHOR_RUNS, n_partitions)
    keyed = docs.select(*_key(), F.coalesce("text", F.lit("")).alias("text"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(text_buffers(batch["text"])[1], BATCH_BYTES):
                yield _send(batch.slice(a, b - a), n_buckets, width, most)

    def judge(table: pa.Table) -> pa.Table:
        return _judge(table, n_buckets)

    def judge_dealt(table: pa.Table) -> pa.Table:
        return _judge_dealt(table)

    judged = stage_and_free(keyed.mapInArrow(send, _SENT_DDL).groupBy("bucket").applyInArrow(judge, _SENT_DDL))
    dealt = judged.where(F.col("doc").isNull()).groupBy("bucket").applyInArrow(judge_dealt, "doc long, variant long, body binary")
    marks = judged.where(F.col("doc").isNotNull()).select("doc", "variant", "body").unionByName(dealt)
    return marks.groupBy("doc", "variant").agg(F.collect_list("body").alias("marks"))


def _key():
    return (
        F.coalesce("doc_id", F.lit(NULL_KEY)).alias("doc"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("variant"),
    )


def cut_words(body: np.ndarray, offsets: np.ndarray, marks: list, width: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Words, removed words and the kept words joined by spaces, per document."""
    starts, ends, firsts = word_bounds(body, offsets)
    gone = np.zeros(len(starts) + 1, np.int64)
    for k, own in enumerate(marks):
        if own:
            mark = np.frombuffer(b"".join(own), _MARK)
            low = firsts[k] + mark["pos"].astype(np.int64)
            np.add.at(gone, low, 1)
            np.add.at(gone, low + mark["count"] + width - 1, -1)
    gone = np.cumsum(gone[:-1]) > 0
    removed = np.concatenate(([0], np.cumsum(gone)))[firsts]
    raw, texts = body.tobytes(), []
    for k in range(len(offsets) - 1):
        a, b = firsts[k], firsts[k + 1]
        if removed[k] == removed[k + 1]:
            texts.append(b" ".join(raw[offsets[k] : offsets[k + 1]].split()).decode())
        else:
            keep = np.flatnonzero(~gone[a:b]) + a
            texts.append(b" ".join([raw[i:j] for i, j in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)]).decode())
    return np.diff(firsts), np.diff(removed), texts


def remove_repeats(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """`docs` with three more columns: n_words, n_removed and kept (kept words joined by one space).

    A word is removed if a window over it has an equal window that starts earlier: in a smaller doc_id
    or further in front in the same document. Null doc_ids count as smallest, rows with the same doc_id as
    one place each: repeated rows get equal results. Null and empty texts have no words. Columns of the
    added names are overwritten.
    """
    marks = repeated_windows(docs, width)
    columns = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept", "doc", "variant", "marks")]
    clash = [c for c in ("doc", "variant", "marks") if c in docs.columns]
    base = docs.select(*[F.col(f"`{c}`") for c in [*columns, *clash]])
    packed = base.select(F.struct(*[F.col(f"`{c}`") for c in base.columns]).alias("row"), F.col("text").alias("body"), *_key())
    joined = packed.join(marks, ["doc", "variant"], "left").select("row", F.coalesce("body", F.lit("")).alias("body"), "marks")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = text_buffers(batch["body"])
            held = batch["marks"]
            for a, b in slices(offsets):
                n, removed, kept = cut_words(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], held.slice(a, b - a).to_pylist(), width)
                yield pa.RecordBatch.from_arrays(
                    [batch["row"].slice(a, b - a), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                    ["row", "n_words", "n_removed", "kept"],
                )

    schema = f"row {packed.schema['row'].dataType.simpleString()}, n_words long, n_removed long, kept string"
    return joined.mapInArrow(cut, schema).select("row.*", "n_words", "n_removed", "kept")


def cut_repeats(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """`docs` with shortened texts where words were removed; other texts keep their white space.

    n_chars, if there is such a column, follows the text.
    """
    cut = remove_repeats(docs, width)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    out = cut.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


@query("op1_substring_dedup")
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated windows of 20 words removed from all documents."""
    done = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
