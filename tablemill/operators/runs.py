"""Training runs: checkpoints, completeness, token statistics, matched checkpoints.

Inputs are exported listings: `paths(location, path)` of checkpoint directories,
`markers(location, exp, value)`, `shards(format, shard, ...)`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablemill.constants import (
    CHECKPOINT_DIR,
    EXPERIMENT,
    FORMATS,
    TARGET_STEP,
    TOKEN_BYTES,
)
from tablemill.session import once, stage


def formats_dim(df: DataFrame) -> DataFrame:
    """The formats as a DataFrame of fixed size."""
    spark = df.sparkSession
    return spark.range(1).select(F.posexplode(F.array(*[F.lit(f) for f in FORMATS])).alias("pos", "format"))


def parse_experiments(names: DataFrame) -> DataFrame:
    """`exp` into format, optional seed and job id; other names drop out."""

    def part(i: int) -> Column:
        return F.regexp_extract("exp", EXPERIMENT, i)

    return names.filter(F.col("exp").rlike(EXPERIMENT)).withColumns(
        {
            "format": part(1),
            "seed": F.nullif(part(2), F.lit("")).try_cast("bigint"),
            "jobid": part(3),
        }
    )


def checkpoint_dirs(paths: DataFrame) -> DataFrame:
    """`exp/.../iter_<n>` paths into experiment, containing directory and step.

    An experiment without any checkpoint stays, with the usual directory and no step.
    """
    parts = F.col("parts")
    split = once(paths.select("location", "path"), F.split("path", "/").alias("parts"))
    named = once(
        split.select("location", "parts"),
        F.get(parts, F.lit(0)).alias("exp"),
        F.regexp_extract(F.element_at(parts, -1), CHECKPOINT_DIR, 1).alias("step"),
    )
    found = named.filter("step <> ''").select(
        "location",
        "exp",
        F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/").alias("ckpt_dir"),
        F.col("step").cast("bigint").alias("iter"),
    )
    bare = named.groupBy("location", "exp").agg(F.max("step").alias("step")).filter("step = ''")
    return found.unionByName(
        bare.select(
            "location", "exp", F.concat("exp", F.lit("/checkpoints")).alias("ckpt_dir"), F.lit(None).cast("bigint").alias("iter")
        )
    )


def nested_layout(dirs: DataFrame, *carried: str) -> DataFrame:
    """The one directory of each experiment that counts: `checkpoints`, the top, else the first nested.

    `carried` are columns that are the same for all rows of a directory.
    """
    rank = (
        F.when(F.col("ckpt_dir") == F.concat("exp", F.lit("/checkpoints")), 0)
        .when(F.col("ckpt_dir") == F.col("exp"), 1)
        .otherwise(2)
    )
    chosen = dirs.groupBy("location", "exp").agg(
        F.min(F.struct(rank.alias("rank"), "ckpt_dir", *carried)).alias("first")
    )
    return chosen.select("location", "exp", *[F.col("first")[c].alias(c) for c in ("ckpt_dir", *carried)])


def checkpoint_iters(dirs: DataFrame) -> DataFrame:
    """Steps of each experiment in its chosen directory."""
    # All directories are gathered and then chosen from, so the listing is read once.
    each = dirs.groupBy("location", "exp", "ckpt_dir").agg(F.sort_array(F.collect_set("iter")).alias("iters"))
    chosen = nested_layout(each, "iters")
    return chosen.select(
        "*", F.array_max("iters").alias("latest_iter"), F.size("iters").cast("bigint").alias("n_iters")
    )


def latest_marker(runs: DataFrame, markers: DataFrame) -> DataFrame:
    """Attach the step named by the marker file, NULL where absent or unreadable."""
    read = markers.select(
        "location", "exp", F.trim("value").try_cast("bigint").alias("latest_marker")
    )
    return runs.join(read, ["location", "exp"], "left")


def merge_locations(runs: DataFrame) -> DataFrame:
    """One row per experiment: scratch wins, the store adds its directory and steps."""
    scratch = runs.filter("location = 'scratch'").drop("location")
    store = runs.filter("location = 'store'").select(
        "exp",
        F.col("ckpt_dir").alias("s_dir"),
        F.col("iters").alias("s_iters"),
        F.col("latest_iter").alias("s_latest"),
    )
    both = F.col("ckpt_dir").isNotNull() & F.col("s_dir").isNotNull()
    return scratch.join(store, "exp", "full_outer").select(
        "exp",
        F.coalesce("ckpt_dir", "s_dir").alias("ckpt_dir"),
        F.coalesce("iters", "s_iters").alias("iters"),
        F.when(F.col("ckpt_dir").isNotNull(), F.col("latest_iter")).otherwise(F.col("s_latest")).alias("latest_iter"),
        F.when(both, F.col("s_dir")).alias("store_ckpt_dir"),
        F.when(both, F.col("s_iters")).alias("store_iters"),
        F.when(both, "scratch+store").when(F.col("ckpt_dir").isNotNull(), "scratch").otherwise("store").alias("location"),
    )


def reached_target(runs: DataFrame, target: int = TARGET_STEP) -> DataFrame:
    latest = F.col("latest_iter")
    return runs.withColumn(
        "reached",
        F.when(latest >= target, "YES")
        .when(latest > 0, F.concat(F.lit("no("), latest.cast("string"), F.lit(")")))
        .otherwise("NONE"),
    )


def format_completeness(runs: DataFrame) -> DataFrame:
    """Runs, finished runs and distinct seeds of every format, also of those without runs."""
    counted = runs.groupBy("format").agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.count_if(F.col("reached") == "YES").alias("n_done"),
        F.array_join(F.transform(F.sort_array(F.collect_set("seed")), lambda s: s.cast("string")), ",").alias("seeds"),
    )
    return formats_dim(runs).drop("pos").join(counted, "format", "left").select(
        "format",
        F.coalesce("n_runs", F.lit(0)).alias("n_runs"),
        F.coalesce("n_done", F.lit(0)).alias("n_done"),
        F.coalesce("seeds", F.lit("")).alias("seeds"),
    )


def missing_formats_runs(runs: DataFrame) -> DataFrame:
    return formats_dim(runs).drop("pos").join(runs, "format", "left_anti")


def job_states(runs: DataFrame, states: DataFrame) -> DataFrame:
    return runs.join(states, "jobid", "left")


# --- token statistics ----------------------------------------------------------


def shard_tokens(indexes: DataFrame, data_files: DataFrame) -> DataFrame:
    """Tokens of each shard; from the size of its data file where the index is unreadable.

    `indexes(format, shard, segments, tokens)` has NULL counts for an unreadable index.
    """
    return indexes.join(data_files, ["format", "shard"], "left").select(
        "format",
        "shard",
        F.coalesce("segments", F.lit(0)).alias("segments"),
        F.coalesce("tokens", F.expr(f"bytes div {TOKEN_BYTES}"), F.lit(0)).alias("tokens"),
    )


def format_token_stats(shards: DataFrame) -> DataFrame:
    stats = shards.groupBy("format").agg(
        F.count(F.lit(1)).alias("n_shards"),
        F.sum("segments").alias("total_segments"),
        F.sum("tokens").alias("total_tokens"),
    )
    return stats.withColumn(
        "tokens_per_segment",
        F.when(F.col("total_segments") > 0, F.col("total_tokens") / F.col("total_segments")).otherwise(0.0),
    )


def token_stats_report(shards: DataFrame) -> DataFrame:
    """Totals of each format with its shards, sorted; a format's list of shards is one value."""
    return shards.groupBy("format").agg(
        F.count(F.lit(1)).alias("n_shards"),
        F.sum("segments").alias("total_segments"),
        F.sum("tokens").alias("total_tokens"),
        F.sort_array(F.collect_list(F.struct("shard", "segments", "tokens"))).alias("shards"),
    )


def relative_size(stats: DataFrame) -> DataFrame:
    """Tokens relative to the most verbose format; formats without tokens are left out."""
    some = stats.filter("total_tokens > 0")
    most = some.agg(F.max("total_tokens").alias("max_tokens"))
    return some.crossJoin(F.broadcast(most)).select(
        "format", "total_tokens", (F.col("total_tokens") / F.col("max_tokens")).alias("fraction")
    )


def matched_fraction(stats: DataFrame, target: int = TARGET_STEP) -> DataFrame:
    """The step at which each format has seen as many rows as the most verbose one at the end."""
    return relative_size(stats).select(
        "format", "fraction", (F.col("fraction") * target).alias("matched_step")
    )


# --- matched checkpoints ---------------------------------------------------------


def filter_runs(
    runs: DataFrame, stats: DataFrame, min_jobid: int = 0, contains: str | None = None
) -> DataFrame:
    """Runs with tokens, checkpoints, a late enough job and a matching name; store copies win."""
    iters = F.when(F.size("store_iters") > 0, F.col("store_iters")).otherwise(F.col("iters"))
    eligible = (
        runs.join(stats.filter("total_tokens > 0").select("format", "total_tokens"), "format")
        .withColumn("available", iters)
        .withColumn("real_ckpt_dir", F.coalesce("store_ckpt_dir", "ckpt_dir"))
        .filter(F.size("available") > 0)
    )
    if min_jobid:
        eligible = eligible.filter(F.coalesce(F.col("jobid").try_cast("bigint"), F.lit(0)) >= min_jobid)
    if contains:
        eligible = eligible.filter(F.col("exp").contains(contains))
    return eligible


def best_run(eligible: DataFrame) -> DataFrame:
    """Per format and seed the run that got furthest, then the one with most checkpoints.

    A minimum over ordered structs combines on the map side, unlike ranks in a window.
    """
    order = F.struct(
        (-F.array_max("available")).alias("a"), (-F.size("available")).alias("b"), F.col("exp").alias("c")
    )
    whole = F.struct(*[F.col(c) for c in eligible.columns])
    return (
        eligible.groupBy("format", "seed")
        .agg(F.min(F.struct(order.alias("o"), whole.alias("run"))).alias("first"))
        .select("first.run.*")
    )


def row_budget(best: DataFrame) -> DataFrame:
    """The smallest exposure over all selected runs, and the run that sets it; one row."""
    rows = F.array_max("available") / F.col("total_tokens")
    return best.agg(
        F.min(rows).alias("budget"), F.min(F.struct(rows.alias("r"), "exp"))["exp"].alias("binding_run")
    )


def snap(target: Column, available: Column) -> Column:
    """The nearest available step; the smaller one on a tie."""
    return F.array_min(
        F.transform(available, lambda i: F.struct(F.abs(i - target).alias("d"), i.alias("i")))
    )["i"]


def eval_plan(best: DataFrame, views_dir: str = "ckpt_views") -> DataFrame:
    """Target and matched step of every selected run at the common row budget."""
    # A run per format and seed; the listing behind it isn't read again for the budget.
    best = stage(best)
    planned = best.crossJoin(F.broadcast(row_budget(best)))
    target = F.rint(F.col("budget") * F.col("total_tokens")).cast("bigint")
    planned = planned.withColumn("target_iter", target)
    planned = planned.withColumn("matched_iter", snap(F.col("target_iter"), F.col("available")))
    delta = 100.0 * (F.col("matched_iter") - F.col("target_iter")) / F.col("target_iter")
    return planned.select(
        F.col("exp").alias("experiment"),
        "format",
        "seed",
        "real_ckpt_dir",
        F.array_max("available").alias("final_iter"),
        "target_iter",
        "matched_iter",
        F.when(F.col("target_iter") == 0, 0.0).otherwise(F.bround(delta, 2)).alias("rows_delta_pct"),
        F.concat(F.lit(views_dir + "/"), "exp", F.lit("__iter"), F.col("matched_iter").cast("string")).alias("view_ckpt_dir"),
        F.format_string("iter_%07d", "matched_iter").alias("step_dir"),
    )


def dropped_runs(eligible: DataFrame, best: DataFrame) -> DataFrame:
    return eligible.join(best.select("exp"), "exp", "left_anti").select("exp")


def eval_jobs(plan: DataFrame, mode: str = "matched") -> DataFrame:
    """One evaluation job per plan row."""
    ckpt = F.col("real_ckpt_dir") if mode == "final" else F.col("view_ckpt_dir")
    seed = F.coalesce(F.col("seed").cast("string"), F.lit("NA"))
    return plan.select(
        "format",
        F.concat(seed, F.lit(f"_{mode}")).alias("seed_tag"),
        ckpt.alias("ckpt"),
        F.col("matched_iter").alias("iter"),
    )
