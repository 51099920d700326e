"""Curves per format: no point is dropped, blocks change nothing."""

import numpy as np
import pytest

from tablemill.operators import curves

RNG = np.random.default_rng(4)
POINTS = [("csv", float(s), float(v)) for s, v in zip(RNG.integers(0, 400, 900), RNG.random(900))] + [("json", 5.0, 0.5), ("json", 5.0, 0.5)]


def by_hand(factor):
    out = []
    for name in ("csv", "json"):
        smooth = None
        for k, (_, step, loss) in enumerate(sorted(p for p in POINTS if p[0] == name)):
            smooth = loss if smooth is None else factor * smooth + (1 - factor) * loss
            out.append((name, step, loss, k + 1, smooth))
    return sorted(out)


@pytest.mark.parametrize("factor", [0.0, 0.1, 0.9, 0.999])
@pytest.mark.parametrize("block", [1, 37, 100_000])
def test_smoothing(spark, factor, block):
    points = spark.createDataFrame(POINTS, "format string, step double, loss double").repartition(5)
    found = sorted((r.format, r.step, r.loss, r.smooth) for r in curves.ema(points, factor, block).collect())
    wanted = [(f, s, v, y) for f, s, v, _, y in by_hand(factor)]
    assert [x[:3] for x in found] == [x[:3] for x in wanted]
    assert np.allclose([x[3] for x in found], [x[3] for x in wanted], atol=1e-9)


def test_numbering(spark):
    points = spark.createDataFrame(POINTS, "format string, step double, loss double").repartition(5)
    found = sorted((r.format, r.step, r.loss, r.pos) for r in curves.sort_curve(points, 50).collect())
    assert found == sorted((f, s, v, k) for f, s, v, k, _ in by_hand(0.5))
