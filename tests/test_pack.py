"""Packing against a plain loop, with and without splits, over batches of any size."""

import random

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from tablemill.constants import FORMATS
from tablemill.operators import scan


def plain(costs, header, budget):
    """(segment ranges, dropped rows) of one table by the defining loop."""
    segments, dropped, start, used = [], [], None, header
    for i, cost in enumerate(costs):
        if cost > budget - header:
            if start is not None:
                segments.append((start, i))
            dropped.append(i)
            start, used = None, header
        elif start is not None and used + cost > budget:
            segments.append((start, i))
            start, used = i, header + cost
        else:
            start = i if start is None else start
            used += cost
    if start is not None:
        segments.append((start, len(costs)))
    return segments, dropped


META = pa.struct(
    [
        ("header_costs", pa.list_(pa.int32())),
        ("base", pa.int64()),
        ("last", pa.bool_()),
        ("used", pa.list_(pa.int32())),
        ("seg_no", pa.list_(pa.int64())),
    ]
)


def batches(splits, header, entries, size):
    """Record batches of `size` rows over `splits: [(table, split, costs)]`."""
    rows = []
    for table, split, costs in splits:
        e = entries.get((table, split), {})
        meta = {
            "header_costs": [header] * 5,
            "base": e.get("base", 0),
            "last": e.get("last", True),
            "used": e.get("used", [-1] * 5),
            "seg_no": e.get("seg_no", [0] * 5),
        }
        for i, c in enumerate(costs):
            rows.append((table, split, i, [f"{table}{split}{i}"], [c] * 5, meta if i == 0 else None))
    for at in range(0, len(rows), size):
        part = rows[at : at + size]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in part], pa.string()),
                pa.array([r[1] for r in part], pa.int32()),
                pa.array([r[2] for r in part], pa.int64()),
                pa.array([r[3] for r in part], pa.list_(pa.string())),
                pa.array([r[4] for r in part], pa.list_(pa.int32())),
                pa.array([r[5] for r in part], META),
            ],
            names=["table_id", "split", "ord", "cells", "costs", "meta"],
        )


def packed(splits, header, budget, entries, size):
    found = []
    for out in scan.pack_scan(budget, False)(batches(splits, header, entries, size)):
        found += [r for r in out.to_pylist() if r["format"] == FORMATS[0]]
    return found


@settings(max_examples=300, deadline=None)
@given(
    tables=st.lists(st.lists(st.integers(0, 14), min_size=1, max_size=40), min_size=1, max_size=5),
    header=st.integers(0, 12),
    budget=st.integers(1, 14),
    size=st.integers(1, 30),
)
def test_scan_equals_loop(tables, header, budget, size):
    splits = [(f"t{i}", 0, costs) for i, costs in enumerate(tables)]
    found = packed(splits, header, budget, {}, size)
    for i, costs in enumerate(tables):
        mine = [r for r in found if r["table_id"] == f"t{i}"]
        segments, dropped = plain(costs, header, budget)
        kept = sorted((r["seg_no"], r["start_ord"], r["end_ord"]) for r in mine if r["seg_no"] is not None)
        assert kept == [(n, a, b) for n, (a, b) in enumerate(segments)]
        assert sorted(r["start_ord"] for r in mine if r["seg_no"] is None) == dropped


@settings(max_examples=300, deadline=None)
@given(
    costs=st.lists(st.integers(0, 14), min_size=1, max_size=60),
    cuts=st.lists(st.integers(1, 59), max_size=6),
    header=st.integers(0, 6),
    budget=st.integers(4, 20),
    size=st.integers(1, 30),
)
def test_splits_equal_loop(costs, cuts, header, budget, size):
    edges = [0, *sorted({c for c in cuts if c < len(costs)}), len(costs)]
    splits = [("t", n, costs[a:b]) for n, (a, b) in enumerate(zip(edges, edges[1:]))]
    reports = list(scan.summarise(budget)(batches(splits, header, {}, size)))
    entries = {}
    for out in scan.chain(iter(reports)):
        for r in out.to_pylist():
            entries[r["table_id"], r["split"]] = r
    found = packed(splits, header, budget, entries, size)
    merged = {}
    for r in found:
        if r["seg_no"] is not None:
            a, b = merged.get(r["seg_no"], (r["start_ord"], r["end_ord"]))
            merged[r["seg_no"]] = (min(a, r["start_ord"]), max(b, r["end_ord"]))
            if not r["part"]:
                assert sum(q["seg_no"] == r["seg_no"] for q in found) == 1
    segments, dropped = plain(costs, header, budget)
    assert [merged[k] for k in sorted(merged)] == segments
    assert sorted(r["start_ord"] for r in found if r["seg_no"] is None) == dropped


@pytest.mark.parametrize("seed", range(3))
def test_long_splits(seed):
    rng = random.Random(seed)
    costs = [rng.choice([0, 1, 3, 7, 40, 130]) for _ in range(5000)]
    splits = [("t", n, costs[a : a + 700]) for n, a in enumerate(range(0, 5000, 700))]
    reports = scan.summarise(120)(batches(splits, 10, {}, 512))
    entries = {("t", r["split"]): r for out in scan.chain(reports) for r in out.to_pylist()}
    found = packed(splits, 10, 120, entries, 512)
    segments, _ = plain(costs, 10, 120)
    ends = {}
    for r in found:
        if r["seg_no"] is not None:
            ends[r["seg_no"]] = max(ends.get(r["seg_no"], 0), r["end_ord"])
    assert [ends[k] for k in sorted(ends)] == [b for _, b in segments]


def test_reports_composed_batch_by_batch():
    import random

    import numpy as np

    from tablemill.operators.scan import CLOSED, _compose, _pieces

    def left_by(pieces, state):
        q = pieces[0] if state == CLOSED else max((p for p in pieces[1:] if p[0] <= state), key=lambda p: p[0])
        used = q[2] + (state if q[1] else 0)
        return (used if q[3] else CLOSED), q[4]

    rng = random.Random(1)
    for _ in range(400):
        room, n = rng.randrange(0, 25), rng.randrange(1, 40)
        costs = np.array([rng.choice([0, 0, 1, 2, 3, 5, room, room + 1, room + 3]) for _ in range(n)])
        whole, composed = _pieces(costs, room), None
        for part in np.split(costs, sorted(rng.sample(range(1, n), min(n - 1, rng.randrange(0, 6))))):
            composed = _pieces(part, room) if composed is None else _compose(composed, _pieces(part, room))
        assert len(composed) <= room + 2
        for state in [CLOSED, *range(room + 1)]:
            assert left_by(composed, state) == left_by(whole, state)


def test_a_report_holds_no_more_than_a_batch():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from tablemill.constants import FORMATS
    from tablemill.operators.scan import summarise

    meta = pa.array([{"header_costs": [1] * len(FORMATS), "base": 0, "last": True, "used": [-1] * len(FORMATS), "seg_no": [0] * len(FORMATS)}])

    def batches(n):
        for _ in range(n):
            costs = pa.ListArray.from_arrays(pa.array(np.arange(1001, dtype=np.int32) * len(FORMATS)), pa.array(np.full(1000 * len(FORMATS), 7, np.int32)))
            ids, zeros, metas = pa.array(["t"] * 1000), pa.array([0] * 1000, pa.int32()), pa.concat_arrays([meta] * 1000)
            yield pa.RecordBatch.from_arrays([ids, zeros, costs, metas], ["table_id", "split", "costs", "meta"])

    def peak(n):
        tracemalloc.start()
        (out,) = summarise(200)(batches(n))
        found = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert out.column("n_rows")[0].as_py() == 1000 * n
        return found

    peak(1)
    assert peak(40) < 1.5 * peak(8)
