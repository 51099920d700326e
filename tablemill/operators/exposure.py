"""Rows that training runs have seen, counted in the order in which segments are trained on.

Equal tokens aren't equal rows, and rows are what runs of different formats should be compared at. Here rows are
counted, not estimated from token totals: a step consumes a fixed number of tokens of a format's
segments, one after the other and over again, and a row is seen when its segment has been read to its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablemill.constants import TOKENS_PER_STEP
from tablemill.operators.prefix import prefix_sums
from tablemill.operators.runs import snap
from tablemill.session import stage


def exposure(segments: DataFrame, by: list[str]) -> DataFrame:
    """`(format, ..., n_rows, n_tokens, n_rows_to, n_tokens_to)`: rows and tokens up to and with each segment, in the order of `by`."""
    return prefix_sums(segments.select("format", *by, "n_rows", "n_tokens"), ["format"], by, ["n_rows", "n_tokens"])


def totals(exposed: DataFrame) -> DataFrame:
    """`(format, all_rows, all_tokens)` of formats with tokens."""
    found = exposed.groupBy("format").agg(F.max("n_rows_to").alias("all_rows"), F.max("n_tokens_to").alias("all_tokens"))
    return found.where("all_tokens > 0 AND all_rows > 0")


def rows_seen(points: DataFrame, exposed: DataFrame, tokens_per_step: int = TOKENS_PER_STEP) -> DataFrame:
    """`points` (with `format` and `step`) and `rows_seen` at that step; formats without tokens have none.

    Points are few, one per run: their side of the join is the small one, and each keeps one maximum per task.
    """
    whole = points.join(totals(exposed), "format")
    used = F.col("step").cast("bigint") * tokens_per_step
    whole = whole.withColumns({"__laps": F.expr(f"(cast(step AS bigint) * {tokens_per_step}) div all_tokens"), "__rest": used % F.col("all_tokens")})
    keys = ["format", "__rest"]
    ends = exposed.select("format", "n_rows_to", "n_tokens_to").join(whole.select(*keys).distinct(), "format")
    found = ends.where("n_tokens_to <= __rest").groupBy(*keys).agg(F.max("n_rows_to").alias("__rows"))
    seen = F.col("__laps") * F.col("all_rows") + F.coalesce("__rows", F.lit(0))
    return whole.join(found, keys, "left").select(*points.columns, seen.alias("rows_seen"))


def steps_at_rows(wanted: DataFrame, exposed: DataFrame, tokens_per_step: int = TOKENS_PER_STEP) -> DataFrame:
    """`wanted` (with `format` and `rows`) and `at_step`, the first step by which the format has seen so many rows.

    No rows are seen at step 0. Formats without tokens have no step.
    """
    whole = wanted.join(totals(exposed), "format")
    whole = whole.withColumn("__laps", F.when(F.col("rows") > 0, F.expr("(rows - 1) div all_rows")).otherwise(0))
    whole = whole.withColumn("__rest", F.col("rows") - F.col("__laps") * F.col("all_rows"))
    keys = ["format", "__rest"]
    ends = exposed.select("format", "n_rows_to", "n_tokens_to").join(whole.select(*keys).distinct(), "format")
    found = ends.where("n_rows_to >= __rest AND __rest > 0").groupBy(*keys).agg(F.min("n_tokens_to").alias("__tokens"))
    used = F.col("__laps") * F.col("all_tokens") + F.coalesce("__tokens", F.lit(0))
    step = F.ceil(used / F.lit(tokens_per_step).cast("decimal(20,0)")).cast("bigint")
    return whole.join(found, keys, "left").select(*wanted.columns, step.alias("at_step"))


def exact_plan(best: DataFrame, exposed: DataFrame, tokens_per_step: int = TOKENS_PER_STEP) -> DataFrame:
    """Per selected run the step and checkpoint at which it has seen as many rows as the run that saw fewest.

    `best` comes from `best_run`. `(experiment, format, seed, final_iter, rows_at_final, row_budget, target_iter,
    matched_iter, rows_at_match)`; beside `eval_plan`, which takes tokens for rows.
    """
    exposed = stage(exposed)
    finals = best.select("exp", "format", "seed", "available", F.array_max("available").alias("step"))
    seen = stage(rows_seen(finals, exposed, tokens_per_step).withColumnsRenamed({"step": "final_iter", "rows_seen": "rows_at_final"}))
    budget = seen.agg(F.min("rows_at_final").alias("rows"))
    planned = stage(steps_at_rows(seen.crossJoin(F.broadcast(budget)), exposed, tokens_per_step))
    planned = planned.withColumn("step", snap(F.col("at_step"), F.col("available")))
    found = rows_seen(planned, exposed, tokens_per_step)
    return found.select(
        F.col("exp").alias("experiment"), "format", "seed", "final_iter", "rows_at_final", F.col("rows").alias("row_budget"),
        F.col("at_step").alias("target_iter"), F.col("step").alias("matched_iter"), F.col("rows_seen").alias("rows_at_match"),
    )
