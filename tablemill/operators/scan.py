"""Ordered scans over sorted partitions: greedy packing of rows into segments.

The scans see rows sorted by (table, split, position). What they hold is the
open segment of one split, never a table: rows of a table arrive over many
Arrow batches, and a table cut into splits is scanned by many tasks. The state
in which a split starts comes from `summarise` and `chain`: each split first
reports how it would leave the packing for every state it could be entered in,
and those reports, a few per split, are chained in order.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tablemill.constants import FORMATS

N = len(FORMATS)
CLOSED = -1


class _Split:
    """Packing state of the split that is being scanned."""

    def __init__(self, table_id, split, meta, budget):
        info = {name: meta.field(name)[0].as_py() for name in ("header_costs", "base", "last", "used", "seg_no")}
        self.table_id, self.split, self.meta = table_id, split, meta
        self.base, self.last = info["base"], info["last"]
        self.rooms = [budget - h for h in info["header_costs"]]
        self.seg = list(info["seg_no"])
        self.used = [max(u, 0) for u in info["used"]]
        self.open = [u != CLOSED for u in info["used"]]
        self.carried = list(self.open)
        self.start = [0] * N


def _costs(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column("costs").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, N).astype(np.int64)


def _bounds(batch: pa.RecordBatch) -> list[int]:
    """Row numbers at which another split begins, with both ends."""
    n = batch.num_rows
    if n == 0:
        return [0]
    ids = batch.column("table_id").dictionary_encode().indices.to_numpy(zero_copy_only=False)
    splits = batch.column("split").to_numpy(zero_copy_only=False)
    changed = (ids[1:] != ids[:-1]) | (splits[1:] != splits[:-1])
    return [0, *(np.flatnonzero(changed) + 1).tolist(), n]


def _walk(state, f, begin, end, total, oversize, emit):
    """Pack rows [begin, end) of one format; `total[i]` is the cost of all rows before i."""
    room, row, at = state.rooms[f], begin, 0
    used, is_open = state.used[f], state.open[f]
    while row < end:
        while at < len(oversize) and oversize[at] < row:
            at += 1
        stop = oversize[at] if at < len(oversize) else end
        fits = int(np.searchsorted(total[row : stop + 1], total[row] + room - used, "right"))
        reach = row + max(fits - 1, 0)
        if reach > row and not is_open:
            is_open, state.start[f], state.carried[f] = True, row, False
        used += int(total[reach] - total[row])
        row = reach
        if reach == end:
            break
        if is_open:
            emit(f, state.start[f], reach, state.seg[f], state.carried[f])
            state.seg[f] += 1
        used, is_open = 0, False
        if reach == stop:
            emit(f, reach, reach + 1, None, False)
            row = reach + 1
    state.used[f], state.open[f] = used, is_open


#: Splits of up to so many rows that lie inside a batch are packed together.
SHORT_SPLIT = 512


def _walk_all(f, begins, ends, meta, budget, costs, total):
    """`_walk` of many splits at once, each from its first row to its last: one step per segment of the longest.

    Gives (start, end, segment or -1, part, split) of the ranges as arrays. `total[i]` is the cost of all rows before i.
    """
    n = len(begins)
    entry = {name: meta.field(name).flatten().to_numpy(zero_copy_only=False).reshape(n, N)[:, f] for name in ("header_costs", "used", "seg_no")}
    room, used, seg = budget - entry["header_costs"].astype(np.int64), entry["used"].astype(np.int64), entry["seg_no"].astype(np.int64)
    is_open, carried = used != CLOSED, used != CLOSED
    used = np.maximum(used, 0)
    start, row = begins.copy(), begins.copy()
    # The next row from each on that is too large for its split.
    over = np.full(len(costs) + 1, len(costs), dtype=np.int64)
    inside = np.repeat(np.arange(n), ends - begins)
    at = np.repeat(begins - np.concatenate([[0], np.cumsum(ends - begins)[:-1]]), ends - begins) + np.arange(len(inside))
    large = at[costs[at] > room[inside]]
    over[large] = large
    over = np.minimum.accumulate(over[::-1])[::-1]
    found = []
    going = np.arange(n)
    while len(going):
        r, e = row[going], ends[going]
        stop = np.minimum(over[r], e)
        reach = np.searchsorted(total, total[r] + room[going] - used[going], "right") - 1
        reach = np.maximum(np.minimum(reach, stop), r)
        new = (reach > r) & ~is_open[going]
        start[going[new]], carried[going[new]] = r[new], False
        is_open[going[new]] = True
        used[going] += total[reach] - total[r]
        left = reach < e
        going, reach, stop = going[left], reach[left], stop[left]
        full = is_open[going]
        ended = going[full]
        found.append((start[ended], reach[full], seg[ended], carried[ended], ended))
        seg[ended] += 1
        used[going], is_open[going] = 0, False
        dropped = reach == stop
        out = going[dropped]
        found.append((reach[dropped], reach[dropped] + 1, np.full(len(out), -1), np.zeros(len(out), bool), out))
        row[going] = reach + dropped
        going = going[row[going] < ends[going]]
    rest = np.flatnonzero(is_open)
    last = meta.field("last").to_numpy(zero_copy_only=False).astype(bool)
    found.append((start[rest], ends[rest], seg[rest], carried[rest] | ~last[rest], rest))
    found = [np.concatenate([part[i] for part in found]) for i in range(5)]
    some = found[1] > found[0]
    return [part[some] for part in found]


def pack_scan(budget: int, with_rows: bool, formats: list[str] | None = None):
    """A `mapInArrow` function from sorted, costed rows to segments.

    Dropped rows come out as ranges without a segment number. `part` marks a
    segment that crosses the border of a split. Other formats than `formats` are left out.
    """
    wanted = [f for f in range(N) if formats is None or FORMATS[f] in formats]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, held = None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            kept = 0 if held is None else held.num_rows
            carried = batch.select(["ord", "cells"] if with_rows else ["ord"])
            buffer = pa.concat_batches([held, carried]) if kept else carried
            costs = _costs(batch)
            totals = np.zeros((kept + batch.num_rows + 1, N), dtype=np.int64)
            np.cumsum(costs, axis=0, out=totals[kept + 1 :])
            totals = np.ascontiguousarray(totals.T)
            bounds = [b + kept for b in _bounds(batch)]
            metas, ranges = [], []
            # Splits between the first and the last begin and end here.
            inner = np.array(bounds[1:-1], dtype=np.int64)
            lengths = inner[1:] - inner[:-1]
            together = set(inner[:-1][lengths <= SHORT_SPLIT].tolist())

            def emit(f, start, end, seg, part):
                if end > start or seg is None:
                    ranges.append((f, start, end, seg, part, len(metas) - 1))

            def close(at):
                for f in wanted:
                    if state.open[f]:
                        emit(f, state.start[f], at, state.seg[f], state.carried[f] or not state.last)

            for begin, end in zip(bounds[:-1], bounds[1:]):
                local = begin - kept
                if begin in together:
                    if state is not None:
                        if not metas:
                            metas.append(state)
                        close(begin)
                        state = None
                    continue
                table_id = batch.column("table_id")[local].as_py()
                split = batch.column("split")[local].as_py()
                if state is not None and (state.table_id, state.split) == (table_id, split):
                    metas.append(state)
                else:
                    if state is not None:
                        if not metas:
                            metas.append(state)
                        close(begin)
                    state = _Split(table_id, split, batch.column("meta").slice(local, 1), budget)
                    state.start = [begin] * N
                    metas.append(state)
                part = costs[local : local + end - begin]
                for f in wanted:
                    over = np.flatnonzero(part[:, f] > state.rooms[f]) + begin
                    _walk(state, f, begin, end, totals[f], over.tolist(), emit)
            yield from _output(buffer, ranges, metas, with_rows)
            if together:
                begins = np.array(sorted(together), dtype=np.int64)
                ends = inner[np.searchsorted(inner, begins, "right")]
                heads = pa.array(begins - kept)
                meta, names, splits = (batch.column(c).take(heads) for c in ("meta", "table_id", "split"))
                bases = meta.field("base").to_numpy(zero_copy_only=False)
                for f in wanted:
                    padded = np.concatenate([np.zeros(kept, dtype=np.int64), costs[:, f]])
                    starts, stops, segs, parts, owner = _walk_all(f, begins, ends, meta, budget, padded, totals[f])
                    if len(starts):
                        seg_no = pa.array(segs, pa.int64(), mask=segs < 0)
                        mine = pa.array(owner)
                        yield _segments(
                            buffer, f, starts, stops, seg_no, parts, names.take(mine), splits.take(mine), bases[owner], meta, owner, with_rows
                        )
            # Keep only rows of segments that are still open.
            n = buffer.num_rows
            first = min((state.start[f] for f in wanted if state.open[f]), default=n)
            state.start = [s - first if state.open[f] else 0 for f, s in enumerate(state.start)]
            held = buffer.slice(first) if first < n else None
        if state is not None:
            metas, ranges = [state], []
            end = 0 if held is None else held.num_rows
            for f in wanted:
                if state.open[f] and end > state.start[f]:
                    part = state.carried[f] or not state.last
                    ranges.append((f, state.start[f], end, state.seg[f], part, 0))
            if ranges:
                yield from _output(held, ranges, metas, with_rows)

    return scan


def _output(buffer, ranges, metas, with_rows):
    if not ranges:
        return
    info = pa.concat_arrays([m.meta for m in metas])
    for f in range(N):
        mine = [r for r in ranges if r[0] == f]
        if not mine:
            continue
        owner = np.array([r[5] for r in mine])
        yield _segments(
            buffer,
            f,
            np.array([r[1] for r in mine]),
            np.array([r[2] for r in mine]),
            pa.array([r[3] for r in mine], pa.int64()),
            np.array([r[4] for r in mine], dtype=bool),
            pa.array([metas[o].table_id for o in owner], pa.string()),
            pa.array([metas[o].split for o in owner], pa.int32()),
            np.array([metas[o].base for o in owner], dtype=np.int64),
            info,
            owner,
            with_rows,
        )


def _segments(buffer, f, starts, ends, seg_no, parts, table_ids, splits, bases, info, owner, with_rows):
    """The ranges `[starts, ends)` of one format as a batch; `owner` points into `info`, which the scan knows of splits."""
    positions = buffer.column("ord").to_numpy(zero_copy_only=False)
    columns = {
        "format": pa.array([FORMATS[f]] * len(starts)),
        "table_id": table_ids,
        "split": splits,
        "seg_no": seg_no,
        "part": pa.array(parts, pa.bool_()),
        "start_ord": pa.array(bases + positions[starts], pa.int64()),
        "end_ord": pa.array(bases + positions[ends - 1] + 1, pa.int64()),
    }
    if with_rows:
        sizes = np.where(seg_no.is_valid().to_numpy(zero_copy_only=False), ends - starts, 0)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        taken = np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])
        cells = buffer.column("cells").take(pa.array(taken))
        columns["rows"] = pa.ListArray.from_arrays(pa.array(offsets), cells)
        detail = info.take(pa.array(owner))
        columns["columns"] = detail.field("columns")
        columns["kv_floats"] = detail.field("kv_floats")
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


# --- packing across splits ---------------------------------------------------


def _pieces(costs: np.ndarray, room: int) -> list[tuple]:
    """How a split maps the state it is entered in to the state it is left in.

    Each piece is `(from_used, relative, used, open, segments)` and holds for
    entry with an open segment of at least `from_used` tokens, up to the next
    piece; `relative` adds `used` to the entry state. The first piece, at
    `CLOSED`, is entry without an open segment. There is one piece per row that
    could be the first not to fit, so at most one per token of the budget.
    """
    n = len(costs)
    total = np.concatenate([[0], np.cumsum(costs)])
    oversize = np.flatnonzero(costs > room)
    known: dict = {}

    def next_oversize(row):
        at = int(np.searchsorted(oversize, row))
        return int(oversize[at]) if at < len(oversize) else n

    def after(row):
        """State and closed segments at the end, when row `row` begins afresh."""
        path = []
        while row not in known:
            stop = next_oversize(row)
            if row == n:
                known[row] = (CLOSED, 0)
                break
            if stop == row:
                path.append((row, row + 1, 0))
                row += 1
                continue
            reach = row + int(np.searchsorted(total[row : stop + 1], total[row] + room, "right")) - 1
            if reach == n:
                known[row] = (int(total[n] - total[row]), 0)
                break
            path.append((row, reach, 1))
            row = reach
        for at, to, closed in reversed(path):
            used, more = known[to]
            known[at] = (used, more + closed)
        return known[path[0][0]] if path else known[row]

    def piece(low, row, was_open):
        used, closed = after(row)
        return (low, False, max(used, 0), used != CLOSED, closed + was_open)

    out = [piece(CLOSED, 0, 0)]
    stop = next_oversize(0)
    spare = room - int(total[stop])
    if spare >= 0:
        # Everything before the first oversize row fits.
        out.append((0, True, int(total[n]), True, 0) if stop == n else piece(0, stop, 1))
    # Entered with more, the segment ends before the first row that does not fit.
    row = min(stop, int(np.searchsorted(total[: stop + 1], room, "right")))
    while row > 0:
        low = max(room - int(total[row]) + 1, 0)
        row = int(np.searchsorted(total[: row + 1], total[row], "left")) - 1
        if row < 0 or low > room:
            break
        if room - int(total[row]) >= low:
            out.append(piece(low, row, 1))
    return out


def _compose(first: list[tuple], second: list[tuple]) -> list[tuple]:
    """The pieces of `first` followed by `second`, equal neighbours put together.

    An entry state is at most the budget, so there is never more than one piece per budget token.
    """
    out: list[tuple] = []

    def add(low, relative, used, is_open, segments):
        if len(out) > 1 and out[-1][1:] == (relative, used, is_open, segments):
            return
        out.append((low, relative, used, is_open, segments))

    starts = [q[0] for q in second[1:]]
    for k, (low, relative, used, is_open, segments) in enumerate(first):
        if not relative:
            q = second[0] if not is_open else second[bisect_right(starts, used)]
            add(low, False, q[2] + (used if q[1] else 0), q[3], segments + q[4])
            continue
        # Entries up to the next piece leave `first` with `used` more, and fall into one or more pieces of `second`.
        high = first[k + 1][0] if k + 1 < len(first) else None
        at = bisect_right(starts, low + used)
        while at < len(second):
            begin = max(low, second[at][0] - used)
            if high is not None and begin >= high:
                break
            _, more, left, stays, closed = second[at]
            add(begin, more, left + (used if more else 0), stays, segments + closed)
            at += 1
    return out


#: Reports that are held as Python objects at a time; each has up to a piece per budget token and format.
REPORTS = 64


def summarise(budget: int):
    """A `mapInArrow` function from sorted, costed rows to one report per split.

    A split's function from entry to exit is composed batch by batch, so what is held is that function and a
    batch of costs, whatever the split's size.
    """

    def report(state, pieces, n_rows):
        fields = ["from_used", "relative", "used", "open", "segments"]
        return {
            "table_id": state.table_id,
            "split": state.split,
            "n_rows": n_rows,
            "pieces": [[dict(zip(fields, p)) for p in pieces[f]] for f in range(N)],
        }

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, pieces, n_rows, done = None, [], 0, []
        for batch in batches:
            costs, bounds = _costs(batch), _bounds(batch)
            for begin, end in zip(bounds[:-1], bounds[1:]):
                key = batch.column("table_id")[begin].as_py(), batch.column("split")[begin].as_py()
                is_new = state is None or (state.table_id, state.split) != key
                if is_new and state is not None:
                    done.append(report(state, pieces, n_rows))
                if len(done) == REPORTS:
                    yield pa.RecordBatch.from_pylist(done, schema=_REPORT)
                    done = []
                if is_new:
                    state, n_rows = _Split(*key, batch.column("meta").slice(begin, 1), budget), 0
                found = [_pieces(costs[begin:end, f], state.rooms[f]) for f in range(N)]
                pieces = found if is_new else [_compose(p, q) for p, q in zip(pieces, found)]
                n_rows += end - begin
        if state is not None:
            done.append(report(state, pieces, n_rows))
            yield pa.RecordBatch.from_pylist(done, schema=_REPORT)

    return scan


_REPORT = pa.schema(
    [
        ("table_id", pa.string()),
        ("split", pa.int32()),
        ("n_rows", pa.int64()),
        (
            "pieces",
            pa.list_(
                pa.list_(
                    pa.struct(
                        [
                            ("from_used", pa.int32()),
                            ("relative", pa.bool_()),
                            ("used", pa.int32()),
                            ("open", pa.bool_()),
                            ("segments", pa.int64()),
                        ]
                    )
                )
            ),
        ),
    ]
)
REPORT_SCHEMA = (
    "table_id string, split int, n_rows bigint, pieces array<array<struct<"
    "from_used: int, relative: boolean, used: int, open: boolean, segments: bigint>>>"
)

ENTRY_SCHEMA = (
    "table_id string, split int, base bigint, last boolean, used array<int>, seg_no array<bigint>"
)


def _reports(batch: pa.RecordBatch) -> Iterator[dict]:
    """A batch's reports, a few as Python objects at a time: all of them may take more than a gigabyte."""
    for at in range(0, batch.num_rows, REPORTS):
        yield from batch.slice(at, REPORTS).to_pylist()


def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Follow the reports of each table in order; gives the state each split is entered in."""
    table, base, used, seg, pending = None, 0, [], [], None
    for batch in batches:
        out = []
        for r in _reports(batch):
            if r["table_id"] != table:
                if pending:
                    out.append({**pending, "last": True})
                table, base, used, seg = r["table_id"], 0, [CLOSED] * N, [0] * N
            elif pending:
                out.append({**pending, "last": False})
            pending = {
                "table_id": table,
                "split": r["split"],
                "base": base,
                "used": list(used),
                "seg_no": list(seg),
            }
            base += r["n_rows"]
            for f in range(N):
                if used[f] == CLOSED:
                    p = r["pieces"][f][0]
                else:
                    p = max(
                        (q for q in r["pieces"][f][1:] if q["from_used"] <= used[f]),
                        key=lambda q: q["from_used"],
                    )
                seg[f] += p["segments"]
                left = p["used"] + (used[f] if p["relative"] else 0)
                used[f] = left if p["open"] else CLOSED
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_ENTRY)
    if pending:
        yield pa.RecordBatch.from_pylist([{**pending, "last": True}], schema=_ENTRY)


_ENTRY = pa.schema(
    [
        ("table_id", pa.string()),
        ("split", pa.int32()),
        ("base", pa.int64()),
        ("last", pa.bool_()),
        ("used", pa.list_(pa.int32())),
        ("seg_no", pa.list_(pa.int64())),
    ]
)
