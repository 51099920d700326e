"""Queries over training runs, token statistics and loss curves."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from tablemill.catalog import sql as S
from tablemill.catalog.corpora import NATION, prepared
from tablemill.catalog.derived import cte, derived
from tablemill.catalog.registry import query
from tablemill.catalog.tables import BUDGET, with_
from tablemill.constants import EXPERIMENT, EXPERIMENT_IN_PATH, FORMATS, TARGET_STEP, TOKENS_PER_STEP
from tablemill.operators import curves, exposure, runs
from tablemill.plans.serialize import serialize
from tablemill.session import new_folder as out_folder
from tablemill.sources import files

FORMAT_ROWS = ", ".join(f"({i}, '{f}')" for i, f in enumerate(FORMATS))

DIRS = rf"""stepped AS (SELECT location, path[:length(path) - strpos(reverse(path), '/')] AS ckpt_dir, split_part(path, '/', 1) AS exp,
    regexp_extract(path, '/iter_([0-9]+)$', 1)::BIGINT AS iter FROM paths WHERE regexp_matches(path, '/iter_[0-9]+$')),
dirs AS (SELECT location, exp, ckpt_dir, iter FROM stepped UNION ALL
  SELECT location, exp, exp || '/checkpoints', NULL FROM (SELECT DISTINCT location, split_part(path, '/', 1) AS exp FROM paths) p
  WHERE NOT EXISTS (SELECT 1 FROM stepped s WHERE s.location = p.location AND s.exp = p.exp)),
chosen AS (SELECT location, exp, min((CASE WHEN ckpt_dir = exp || '/checkpoints' THEN 0 WHEN ckpt_dir = exp THEN 1 ELSE 2 END, ckpt_dir))[2] AS ckpt_dir
           FROM dirs GROUP BY location, exp),
iters AS (SELECT location, exp, ckpt_dir, coalesce(list_sort(list(DISTINCT iter) FILTER (iter IS NOT NULL)), []) AS iters, max(iter) AS latest_iter, count(DISTINCT iter) AS n_iters
          FROM dirs JOIN chosen USING (location, exp, ckpt_dir) GROUP BY ALL)"""
RUNS = rf"""{DIRS},
merged AS (SELECT exp, coalesce(a.ckpt_dir, b.ckpt_dir) AS ckpt_dir, coalesce(a.iters, b.iters) AS iters,
    CASE WHEN a.exp IS NOT NULL THEN a.latest_iter ELSE b.latest_iter END AS latest_iter,
    CASE WHEN a.exp IS NOT NULL AND b.exp IS NOT NULL THEN b.ckpt_dir END AS store_ckpt_dir,
    CASE WHEN a.exp IS NOT NULL AND b.exp IS NOT NULL THEN b.iters END AS store_iters,
    CASE WHEN a.exp IS NOT NULL AND b.exp IS NOT NULL THEN 'scratch+store' WHEN a.exp IS NOT NULL THEN 'scratch' ELSE 'store' END AS location
  FROM (SELECT * FROM iters WHERE location = 'scratch') a FULL JOIN (SELECT * FROM iters WHERE location = 'store') b USING (exp)),
runs AS (SELECT *, regexp_extract(exp, '{EXPERIMENT}', 1) AS format, nullif(regexp_extract(exp, '{EXPERIMENT}', 2), '')::BIGINT AS seed,
    regexp_extract(exp, '{EXPERIMENT}', 3) AS jobid FROM merged WHERE regexp_matches(exp, '{EXPERIMENT}')),
reached AS (SELECT *, CASE WHEN latest_iter >= {TARGET_STEP} THEN 'YES' WHEN latest_iter > 0 THEN 'no(' || latest_iter || ')' ELSE 'NONE' END AS reached FROM runs)"""
PATHS = cte("paths")


def _dirs(spark, sf) -> DataFrame:
    return runs.checkpoint_dirs(derived(spark, sf, "paths"))


def _runs(spark, sf) -> DataFrame:
    return runs.reached_target(
        runs.parse_experiments(runs.merge_locations(runs.checkpoint_iters(_dirs(spark, sf))))
    )


def joined(column: str) -> F.Column:
    return F.array_join(F.transform(column, lambda i: i.cast("string")), ",").alias(column)


@query("checkpoint_listing", f"{PATHS}, {DIRS} SELECT location, exp, ckpt_dir, iter FROM dirs")
def listing(spark, sf):
    return _dirs(spark, sf)


@query(
    "parse_experiments",
    f"{PATHS}, {RUNS} SELECT exp, format, seed, jobid FROM runs",
)
def experiments(spark, sf):
    return _runs(spark, sf).select("exp", "format", "seed", "jobid")


@query("nested_layout", f"{PATHS}, {DIRS} SELECT location, exp, ckpt_dir FROM chosen")
def layout(spark, sf):
    return runs.nested_layout(_dirs(spark, sf))


@query(
    "checkpoint_iters",
    f"{PATHS}, {DIRS} SELECT location, exp, ckpt_dir, array_to_string(iters, ',') AS iters, latest_iter, n_iters FROM iters",
)
def iters(spark, sf):
    return runs.checkpoint_iters(_dirs(spark, sf)).withColumn("iters", joined("iters"))


EXP_OF = "exps AS (SELECT DISTINCT o_custkey, exp FROM order_exps)"


@query(
    "latest_marker",
    f"{cte('paths', 'markers', 'order_exps')}, {DIRS}, {EXP_OF} SELECT i.location, i.exp, i.latest_iter, try_cast(trim(m.value) AS BIGINT) AS latest_marker "
    "FROM iters i LEFT JOIN (SELECT location, exp, value FROM markers JOIN exps USING (o_custkey)) m ON m.location = i.location AND m.exp = i.exp",
)
def marker(spark, sf):
    names = derived(spark, sf, "order_exps").select("o_custkey", "exp").distinct()
    markers = derived(spark, sf, "markers").join(names, "o_custkey")
    found = runs.latest_marker(runs.checkpoint_iters(_dirs(spark, sf)), markers)
    return found.select("location", "exp", "latest_iter", "latest_marker")


@query(
    "merge_locations",
    f"{PATHS}, {RUNS} SELECT exp, ckpt_dir, latest_iter, store_ckpt_dir, array_to_string(store_iters, ',') AS store_iters, location FROM merged",
)
def merged(spark, sf):
    found = runs.merge_locations(runs.checkpoint_iters(_dirs(spark, sf)))
    return found.drop("iters").withColumn("store_iters", joined("store_iters"))


@query("reached_target", f"{PATHS}, {RUNS} SELECT exp, latest_iter, reached FROM reached")
def reached(spark, sf):
    return _runs(spark, sf).select("exp", "latest_iter", "reached")


@query(
    "format_completeness",
    f"{PATHS}, {RUNS} SELECT f.format, count(r.exp) AS n_runs, count(*) FILTER (reached = 'YES') AS n_done, "
    "coalesce(array_to_string(list_sort(list(DISTINCT seed) FILTER (seed IS NOT NULL)), ','), '') AS seeds "
    f"FROM (VALUES {FORMAT_ROWS}) f(pos, format) LEFT JOIN reached r USING (format) GROUP BY f.format",
)
def completeness(spark, sf):
    return runs.format_completeness(_runs(spark, sf))


@query(
    "missing_formats_runs",
    f"{cte('few_paths')}, {RUNS.replace('FROM paths', 'FROM few_paths')} SELECT format FROM (VALUES {FORMAT_ROWS}) f(pos, format) "
    "WHERE format NOT IN (SELECT format FROM runs)",
)
def missing(spark, sf):
    listed = runs.checkpoint_iters(runs.checkpoint_dirs(derived(spark, sf, "few_paths")))
    return runs.missing_formats_runs(runs.parse_experiments(runs.merge_locations(listed)))


@query(
    "job_states",
    f"{cte('paths', 'states')}, {RUNS} SELECT exp, runs.jobid, state FROM runs LEFT JOIN states USING (jobid)",
)
def states(spark, sf):
    return runs.job_states(_runs(spark, sf), derived(spark, sf, "states")).select("exp", "jobid", "state")


# --- token statistics -----------------------------------------------------------

SHARDS = """index_ AS (SELECT format, shard, CASE WHEN shard LIKE '%7' THEN NULL ELSE count(*) END AS segments,
   CASE WHEN shard LIKE '%7' THEN NULL ELSE sum(n_chars) END AS tokens, sum(n_chars) * 4 + 3 AS bytes FROM doc_shards GROUP BY format, shard),
shard AS (SELECT format, shard, coalesce(segments, 0) AS segments, coalesce(tokens, CASE WHEN shard LIKE '%17' THEN NULL ELSE bytes // 4 END, 0) AS tokens FROM index_),
stats AS (SELECT format, count(*) AS n_shards, sum(segments) AS total_segments, sum(tokens) AS total_tokens FROM shard GROUP BY format)"""
DOCS = cte("doc_shards")


def _shards(spark, sf) -> DataFrame:
    grouped = derived(spark, sf, "doc_shards").groupBy("format", "shard").agg(
        F.count(F.lit(1)).alias("segments"), F.sum("n_chars").alias("tokens")
    )
    readable = ~F.col("shard").endswith("7")
    indexes = grouped.select(
        "format",
        "shard",
        F.when(readable, F.col("segments")).alias("segments"),
        F.when(readable, F.col("tokens")).alias("tokens"),
    )
    # Some data files beside unreadable indexes are empty.
    data = grouped.select(
        "format", "shard", F.when(F.col("shard").endswith("17"), 0).otherwise(F.col("tokens") * 4 + 3).alias("bytes")
    )
    return runs.shard_tokens(indexes, data)


def _stats(spark, sf) -> DataFrame:
    return runs.format_token_stats(_shards(spark, sf))


@query("bin_fallback", f"{DOCS}, {SHARDS} SELECT * FROM shard")
def fallback(spark, sf):
    return _shards(spark, sf)


@query(
    "format_token_stats",
    f"{DOCS}, {SHARDS} SELECT *, CASE WHEN total_segments > 0 THEN total_tokens / total_segments ELSE 0 END AS tokens_per_segment FROM stats",
)
def token_stats(spark, sf):
    return _stats(spark, sf)


@query(
    "relative_size",
    f"{DOCS}, {SHARDS} SELECT format, total_tokens, total_tokens / max(total_tokens) OVER () AS fraction FROM stats WHERE total_tokens > 0",
)
def relative(spark, sf):
    return runs.relative_size(_stats(spark, sf))


@query(
    "matched_fraction",
    f"{DOCS}, {SHARDS} SELECT format, total_tokens / max(total_tokens) OVER () AS fraction, "
    f"total_tokens / max(total_tokens) OVER () * {TARGET_STEP} AS matched_step FROM stats WHERE total_tokens > 0",
)
def fraction(spark, sf):
    return runs.matched_fraction(_stats(spark, sf))


@query(
    "write_token_stats",
    f"{DOCS}, {SHARDS} SELECT format, n_shards, total_segments, total_tokens, shards FROM stats JOIN "
    "(SELECT format, string_agg(shard || ':' || segments || ':' || tokens, ',' ORDER BY shard) AS shards FROM shard GROUP BY format) USING (format)",
)
def stats_file(spark, sf):
    path = out_folder(spark)
    files.write_token_stats(runs.token_stats_report(_shards(spark, sf)), path)
    each = F.transform("shards", lambda s: F.concat_ws(":", s["shard"], s["segments"], s["tokens"]))
    return files.read_token_stats(spark, path).withColumn("shards", F.array_join(each, ","))


@query(
    "write_assessment",
    f"{PATHS}, {RUNS} SELECT exp, format, seed, jobid, ckpt_dir, array_to_string(iters, ',') AS iters, latest_iter, location FROM runs",
)
def assessment_file(spark, sf):
    path = out_folder(spark)
    files.write_assessment(_runs(spark, sf).drop("reached"), path)
    found = files.read_assessment(spark, path)
    return found.select("exp", "format", "seed", "jobid", "ckpt_dir", joined("iters"), "latest_iter", "location")


# --- matched checkpoints ----------------------------------------------------------

PLAN = f"""{cte('paths', 'doc_shards')}, {RUNS}, {SHARDS},
eligible AS (SELECT runs.*, total_tokens, CASE WHEN len(store_iters) > 0 THEN store_iters ELSE iters END AS available,
    coalesce(store_ckpt_dir, ckpt_dir) AS real_ckpt_dir FROM runs JOIN stats USING (format) WHERE total_tokens > 0 AND jobid::BIGINT >= 2590100
    AND len(CASE WHEN len(store_iters) > 0 THEN store_iters ELSE iters END) > 0),
best AS (SELECT * FROM eligible QUALIFY row_number() OVER (PARTITION BY format, seed ORDER BY list_max(available) DESC, len(available) DESC, exp) = 1),
budget AS (SELECT min(list_max(available) / total_tokens) AS budget, min((list_max(available) / total_tokens, exp))[2] AS binding_run FROM best),
targets AS (SELECT best.*, round_even(budget * total_tokens, 0)::BIGINT AS target_iter FROM best, budget),
snapped AS (SELECT *, list_min(list_transform(available, lambda i: (abs(i - target_iter), i)))[2] AS matched_iter FROM targets),
plan AS (SELECT exp AS experiment, format, seed, real_ckpt_dir, list_max(available) AS final_iter, target_iter, matched_iter,
    CASE WHEN target_iter = 0 THEN 0 ELSE round_even(100.0::DOUBLE * (matched_iter - target_iter) / target_iter, 2) END::DOUBLE AS rows_delta_pct,
    'ckpt_views/' || exp || '__iter' || matched_iter AS view_ckpt_dir, 'iter_' || lpad(matched_iter::VARCHAR, 7, '0') AS step_dir FROM snapped)"""


def _eligible(spark, sf) -> DataFrame:
    return runs.filter_runs(_runs(spark, sf), _stats(spark, sf), 2590100, "tabular")


def _best(spark, sf) -> DataFrame:
    return runs.best_run(_eligible(spark, sf))


def _plan(spark, sf) -> DataFrame:
    return runs.eval_plan(_best(spark, sf))


@query("filter_runs", f"{PLAN} SELECT exp, total_tokens, array_to_string(available, ',') AS available FROM eligible")
def eligible(spark, sf):
    return _eligible(spark, sf).select("exp", "total_tokens", joined("available"))


@query("best_run", f"{PLAN} SELECT exp, format, seed FROM best")
def best(spark, sf):
    return _best(spark, sf).select("exp", "format", "seed")


@query("row_budget", f"{PLAN} SELECT budget, binding_run FROM budget")
def budget(spark, sf):
    return runs.row_budget(_best(spark, sf))


@query("target_iter", f"{PLAN} SELECT experiment, target_iter FROM plan")
def target(spark, sf):
    return _plan(spark, sf).select("experiment", "target_iter")


@query("snap_checkpoint", f"{PLAN} SELECT experiment, target_iter, matched_iter FROM plan")
def snapped(spark, sf):
    return _plan(spark, sf).select("experiment", "target_iter", "matched_iter")


@query("rows_delta", f"{PLAN} SELECT experiment, rows_delta_pct FROM plan")
def delta(spark, sf):
    return _plan(spark, sf).select("experiment", "rows_delta_pct")


@query("eval_plan", f"{PLAN} SELECT * FROM plan")
def plan(spark, sf):
    return _plan(spark, sf)


@query("write_plan", f"{PLAN} SELECT * FROM plan")
def plan_file(spark, sf):
    path = out_folder(spark)
    files.write_plan(_plan(spark, sf), path)
    return files.read_plan(spark, path)


@query("dropped_runs", f"{PLAN} SELECT exp FROM eligible WHERE exp NOT IN (SELECT exp FROM best)")
def dropped(spark, sf):
    found = _eligible(spark, sf)
    return runs.dropped_runs(found, runs.best_run(found))


# Tokens of a step of the runs above over the segments of one small corpus: many laps.
STEP_TOKENS = 7
EXACT = f"""{S.packed(NATION, BUDGET)}, {S.slices('packed')}, {re.sub(r'\bstats\b', 'token_stats', PLAN.removeprefix('WITH '))},
seg AS (SELECT s.format, s.table_id, s.seg, any_value({S.tokens('text')}) AS n_tokens, count(*) AS n_rows
        FROM slice_text s JOIN packed p ON p.format = s.format AND p.table_id = s.table_id AND p.seg = s.seg GROUP BY s.format, s.table_id, s.seg),
cum AS (SELECT *, sum(n_rows) OVER o AS rows_to, sum(n_tokens) OVER o AS tokens_to FROM seg WINDOW o AS (PARTITION BY format ORDER BY table_id, seg)),
tot AS (SELECT format, max(rows_to) AS all_rows, max(tokens_to) AS all_tokens FROM cum GROUP BY format),
fin AS (SELECT exp, b.format, seed, available, list_max(available) AS final_iter, (list_max(available) * {STEP_TOKENS}) // all_tokens * all_rows
          + coalesce((SELECT max(rows_to) FROM cum c WHERE c.format = b.format AND c.tokens_to <= (list_max(b.available) * {STEP_TOKENS}) % all_tokens), 0) AS rows_at_final,
          all_rows, all_tokens FROM best b JOIN tot ON tot.format = b.format),
goal AS (SELECT min(rows_at_final) AS r FROM fin),
lap AS (SELECT fin.*, r, (r - 1) // all_rows AS laps, r - (r - 1) // all_rows * all_rows AS rest FROM fin, goal),
aim AS (SELECT lap.*, (laps * all_tokens + (SELECT min(tokens_to) FROM cum c WHERE c.format = lap.format AND c.rows_to >= lap.rest) + {STEP_TOKENS - 1}) // {STEP_TOKENS} AS at_step FROM lap),
near AS (SELECT *, list_min(list_transform(available, lambda i: (abs(i - at_step), i)))[2] AS matched_iter FROM aim)"""


@query(
    "exact_row_plan",
    with_(
        EXACT,
        "SELECT exp AS experiment, format, seed, final_iter, rows_at_final::BIGINT AS rows_at_final, r::BIGINT AS row_budget, at_step::BIGINT AS target_iter, matched_iter, "
        f"((matched_iter * {STEP_TOKENS}) // all_tokens * all_rows + coalesce((SELECT max(rows_to) FROM cum c WHERE c.format = near.format "
        f"AND c.tokens_to <= (near.matched_iter * {STEP_TOKENS}) % all_tokens), 0))::BIGINT AS rows_at_match FROM near",
        True,
    ),
)
def exact(spark, sf):
    segments = serialize(prepared(spark, sf, NATION), BUDGET)
    return exposure.exact_plan(_best(spark, sf), exposure.exposure(segments, ["table_id", "seg_no"]), STEP_TOKENS)


JOBS = (
    "SELECT format, coalesce(seed::VARCHAR, 'NA') || '_{mode}' AS seed_tag, {ckpt} AS ckpt, matched_iter AS iter FROM plan"
)
query("eval_jobs", f"{PLAN} {JOBS.format(mode='matched', ckpt='view_ckpt_dir')}")(
    lambda spark, sf: runs.eval_jobs(_plan(spark, sf))
)
query("eval_jobs_final", f"{PLAN} {JOBS.format(mode='final', ckpt='real_ckpt_dir')}")(
    lambda spark, sf: runs.eval_jobs(_plan(spark, sf), "final")
)


# --- curves -------------------------------------------------------------------------

FACTOR = 0.9
CURVE = """sorted AS (SELECT format, step, loss, row_number() OVER (PARTITION BY format ORDER BY step, loss) AS pos FROM event_points)"""
SMOOTH = f"""{CURVE},
smooth AS (SELECT format, step, pos, loss, loss AS s FROM sorted WHERE pos = 1
  UNION ALL SELECT n.format, n.step, n.pos, n.loss, {FACTOR}::DOUBLE * w.s + (1 - {FACTOR}::DOUBLE) * n.loss
  FROM smooth w JOIN sorted n ON n.format = w.format AND n.pos = w.pos + 1)"""
AXIS = f"""{SMOOTH}, {SHARDS},
axis AS (SELECT smooth.format, step, s, step * {TOKENS_PER_STEP} * ((SELECT max(total_tokens) FROM stats) / total_tokens) / 1e9 AS x
         FROM smooth JOIN stats USING (format) WHERE total_tokens > 0)"""
AT = f"""{AXIS}, ends AS (SELECT format, max((x, s)) FILTER (x <= {curves.BUDGET_X}) AS l, min((x, s)) FILTER (x >= {curves.BUDGET_X}) AS r FROM axis GROUP BY format),
at_budget AS (SELECT format, CASE WHEN l IS NULL OR l[1] = r[1] THEN r[2]
   ELSE l[2] + (r[2] - l[2]) * ({curves.BUDGET_X} - l[1]) / (r[1] - l[1]) END AS loss FROM ends WHERE r IS NOT NULL)"""
POINTS = cte("event_points", "doc_shards").replace("WITH ", "WITH RECURSIVE ", 1)


def _curve(spark, sf) -> DataFrame:
    return derived(spark, sf, "event_points").select("format", "step", "loss")


def _axis(spark, sf) -> DataFrame:
    smooth = curves.ema(_curve(spark, sf), FACTOR).withColumnRenamed("smooth", "y")
    return curves.rows_seen_axis(smooth, _stats(spark, sf))


@query("sort_curve", f"{POINTS}, {CURVE} SELECT format, step, loss, pos FROM sorted")
def curve(spark, sf):
    return curves.sort_curve(_curve(spark, sf)).select("format", "step", "loss", "pos")


@query(
    "select_loss_tag",
    f"{cte('scalars')}, f AS (SELECT *, regexp_extract(path, '{EXPERIMENT_IN_PATH}', 1) AS format, "
    "CASE WHEN lower(tag) = 'lm loss' THEN 0 WHEN lower(tag) LIKE '%loss%' AND lower(tag) NOT LIKE '%scale%' THEN 1 END AS rank FROM scalars), "
    "t AS (SELECT path, min((rank, tag_pos, tag))[3] AS tag FROM f WHERE rank IS NOT NULL AND format <> '' GROUP BY path) "
    "SELECT format, path, step, value AS loss FROM f JOIN t USING (path, tag)",
)
def tags(spark, sf):
    return curves.select_loss_tag(derived(spark, sf, "scalars"))


@query("ema", f"{POINTS}, {SMOOTH} SELECT format, step, round(s, 6) AS smooth FROM smooth")
def ema(spark, sf):
    return curves.ema(_curve(spark, sf), FACTOR).select("format", "step", F.round("smooth", 6).alias("smooth"))


@query("rows_seen_axis", f"{POINTS}, {AXIS} SELECT format, step, round(x, 6) AS x FROM axis")
def axis(spark, sf):
    return _axis(spark, sf).select("format", "step", F.round("x", 6).alias("x"))


@query("loss_at_budget", f"{POINTS}, {AT} SELECT format, round(loss, 6) AS loss FROM at_budget")
def at_budget(spark, sf):
    return curves.loss_at_budget(_axis(spark, sf)).withColumn("loss", F.round("loss", 6))


@query(
    "best_format",
    f"{POINTS}, {AT}, ranked AS (SELECT f.pos, a.format, min(round(loss, 6)) AS loss FROM at_budget a JOIN (VALUES {FORMAT_ROWS}) f(pos, format) USING (format) GROUP BY ALL) "
    "SELECT format, loss FROM ranked ORDER BY loss, pos LIMIT 1",
)
def best_format(spark, sf):
    losses = curves.loss_at_budget(_axis(spark, sf)).withColumn("loss", F.round("loss", 6))
    return curves.best_format(losses)


@query(
    "loss_curve_csv",
    f"{cte('event_points')} SELECT format, step, loss FROM event_points",
)
def from_csv(spark, sf):
    from tablemill.catalog.evaluation import new_folder
    from tablemill.sources.files import loss_curve_csv

    path = new_folder(spark)
    points = derived(spark, sf, "event_points")
    points.select(F.concat(F.lit(" "), "format", F.lit(" ")).alias("format"), "step", "loss").write.csv(
        path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    return loss_curve_csv(spark, path)
