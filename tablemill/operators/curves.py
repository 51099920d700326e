"""Loss curves: tag choice, smoothing, the rows axis, loss at a common budget."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tablemill.constants import EXPERIMENT_IN_PATH, FORMATS, TARGET_STEP, TOKENS_PER_STEP

BUDGET_X = TARGET_STEP * TOKENS_PER_STEP / 1e9


def select_loss_tag(scalars: DataFrame) -> DataFrame:
    """Points of each event file's loss: `lm loss`, else the first loss that is no scale.

    `scalars(path, tag, tag_pos, step, value)`. Every point is kept; the files of a format
    together are its curve.
    """
    tag = F.lower("tag")
    rank = F.when(tag == "lm loss", 0).when(tag.contains("loss") & ~tag.contains("scale"), 1)
    named = scalars.withColumn("format", F.regexp_extract("path", EXPERIMENT_IN_PATH, 1))
    tags = (
        named.withColumn("rank", rank)
        .filter("rank is not null and format <> ''")
        .groupBy("path")
        .agg(F.min(F.struct("rank", "tag_pos", "tag"))["tag"].alias("tag"))
    )
    return named.join(tags, ["path", "tag"]).select(
        "format", "path", "step", F.col("value").alias("loss")
    )


# Steps per block; long curves are numbered and smoothed block by block.
BLOCK_STEPS = 100_000


def _blocked(points: DataFrame, block_steps: int) -> DataFrame:
    return points.withColumn("block", F.floor(F.col("step") / block_steps).cast("bigint"))


def sort_curve(points: DataFrame, block_steps: int = BLOCK_STEPS) -> DataFrame:
    """Number the points of each format's curve by step, those of one step by loss.

    `points(format, step, loss)` may come from several files; no point is dropped.
    """
    blocked = _blocked(points, block_steps)
    before = Window.partitionBy("format").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # One row per block, however many points a curve has.
    bases = (
        blocked.groupBy("format", "block")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("format", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    )
    within = Window.partitionBy("format", "block").orderBy("step", "loss")
    numbered = blocked.withColumn("pos", F.row_number().over(within))
    return (
        numbered.join(bases, ["format", "block"])
        .withColumn("pos", F.col("pos") + F.col("base"))
        .drop("block", "base")
    )


def ema(points: DataFrame, factor: float, block_steps: int = BLOCK_STEPS) -> DataFrame:
    """Exponential moving average along each curve, starting from its first value.

    The average is linear in its start: a block of steps contributes its own
    average from zero and a power of the factor times what came in. So
    blocks are scanned by separate tasks, and only one number per block is chained.
    """
    if factor <= 0:
        return points.withColumn("smooth", F.col("loss"))
    scanned = (
        _blocked(points, block_steps)
        .repartition("format", "block")
        .sortWithinPartitions("format", "block", "step", "loss")
        .select("format", "block", "step", "loss")
        .mapInPandas(
            _from_zero(factor), "format string, block bigint, step double, loss double, part double, n bigint"
        )
    )
    ends = (
        scanned.groupBy("format", "block")
        .agg(F.max("n").alias("n"), F.max_by("part", "n").alias("part"), F.min_by("loss", "n").alias("first"))
        .repartition("format")
        .sortWithinPartitions("format", "block")
        .mapInPandas(_carry(factor), "format string, block bigint, carry double")
    )
    return scanned.join(ends, ["format", "block"]).select(
        "format",
        "step",
        "loss",
        (F.col("part") + F.pow(F.lit(factor), F.col("n")) * F.col("carry")).alias("smooth"),
    )


def average(loss: np.ndarray, factor: float, start: float) -> np.ndarray:
    """The exponential moving average after each value, a stretch of values at a time.

    Within a stretch weights are powers of the factor, which stay above a millionth.
    """
    stretch = max(1, int(-6 / np.log10(factor))) if factor < 1 else len(loss) or 1
    power = factor ** np.arange(1, stretch + 1)
    out = np.empty(len(loss))
    for a in range(0, len(loss), stretch):
        part = loss[a : a + stretch]
        weight = power[: len(part)]
        out[a : a + stretch] = weight * (start + (1 - factor) * np.cumsum(part / weight))
        start = out[a + len(part) - 1]
    return out


def _from_zero(factor: float):
    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, acc, n = None, 0.0, 0
        for frame in frames:
            parts, counts = np.empty(len(frame)), np.empty(len(frame), dtype="int64")
            new = (frame["format"] != frame["format"].shift()) | (frame["block"] != frame["block"].shift())
            cuts = [*np.flatnonzero(new.to_numpy()), len(frame)]
            losses = frame["loss"].to_numpy()
            for a, b in zip(cuts, cuts[1:]):
                here = (frame["format"].iloc[a], frame["block"].iloc[a])
                if here != key:
                    key, acc, n = here, 0.0, 0
                parts[a:b] = average(losses[a:b], factor, acc)
                counts[a:b] = np.arange(n + 1, n + 1 + b - a)
                acc, n = parts[b - 1], n + b - a
            yield frame.assign(part=parts, n=counts)

    return scan


def _carry(factor: float):
    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        curve, carry = None, 0.0
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                if r.format != curve:
                    curve, carry = r.format, r.first
                out.append((r.format, r.block, carry))
                carry = r.part + factor**r.n * carry
            yield pd.DataFrame(out, columns=["format", "block", "carry"])

    return scan


def rows_seen_axis(curve: DataFrame, stats: DataFrame) -> DataFrame:
    """Put each format's steps on the rows axis of the most verbose format, in billions."""
    some = stats.filter("total_tokens > 0").select("format", "total_tokens")
    most = some.agg(F.max("total_tokens").alias("max_tokens"))
    return (
        curve.join(some.crossJoin(most), "format")
        .withColumn(
            "x", F.col("step") * TOKENS_PER_STEP * (F.col("max_tokens") / F.col("total_tokens")) / 1e9
        )
        .drop("total_tokens", "max_tokens")
    )


def loss_at_budget(curve: DataFrame, budget_x: float = BUDGET_X) -> DataFrame:
    """Linear interpolation of `y` at the budget, for curves that reach it."""
    below, above = F.col("x") <= budget_x, F.col("x") >= budget_x
    point = F.struct("x", "y")
    ends = curve.groupBy("format").agg(
        F.max(F.when(below, point)).alias("l"), F.min(F.when(above, point)).alias("r")
    )
    l, r = F.col("l"), F.col("r")
    inside = l["y"] + (r["y"] - l["y"]) * (F.lit(budget_x) - l["x"]) / (r["x"] - l["x"])
    loss = F.when(l.isNull() | (l["x"] == r["x"]), r["y"]).otherwise(inside)
    return ends.filter(r.isNotNull()).select("format", loss.alias("loss"))


def best_format(losses: DataFrame) -> DataFrame:
    """The format with the lowest loss; the earlier one on a tie."""
    order = F.array_position(F.array(*[F.lit(f) for f in FORMATS]), F.col("format"))
    best = F.min(F.struct("loss", order.alias("pos"), "format"))
    return losses.agg(best["format"].alias("format"), best["loss"].alias("loss")).filter(
        "format is not null"
    )
