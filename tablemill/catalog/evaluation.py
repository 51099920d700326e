"""Queries over pairs, responses, scores and file sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablemill.catalog import sql as S
from tablemill.catalog.corpora import EVENT, LINE, NATION, NUMBERS, prepared
from tablemill.catalog.derived import cte, derived
from tablemill.catalog.registry import query
from tablemill.catalog.tables import BUDGET, SMALL, fit_sql, with_
from tablemill.constants import PAIR_TYPES
from tablemill.operators import checks, clean, fit, order, pack, pairs, score
from tablemill.plans.serialize import serialize
from tablemill.session import new_folder, stage
from tablemill.sources import files


# --- resume -------------------------------------------------------------------

IDS = "ids AS (SELECT DISTINCT trim(value) AS table_id FROM id_lines WHERE trim(value) <> '')"


@query("completed_ids", f"{cte('id_lines')}, {IDS} SELECT table_id FROM ids")
def completed(spark, sf):
    path = new_folder(spark)
    derived(spark, sf, "id_lines").write.text(path)
    return files.completed_ids(spark, path)


@query(
    "resume_tables",
    f"{cte('id_lines', 'pair_lines')}, {IDS} SELECT DISTINCT table_id FROM pair_lines "
    "WHERE replace(table_id, 'c', 'u') NOT IN (SELECT table_id FROM ids)",
)
def resume_tables(spark, sf):
    done = files.distinct_ids(derived(spark, sf, "id_lines"))
    done = done.select(F.replace("table_id", F.lit("u"), F.lit("c")).alias("table_id"))
    return score.resume_tables(derived(spark, sf, "pair_lines").select("table_id").distinct(), done)


@query(
    "read_pairs",
    f"{cte('pair_lines')} SELECT table_id, statement, distractor, coalesce(type, 'unknown') AS type FROM pair_lines",
)
def read_pairs(spark, sf):
    path = new_folder(spark)
    derived(spark, sf, "pair_lines").select("table_id", "statement", "distractor", "type").write.json(path)
    return files.read_pairs(spark, path).drop("table_serialized")


@query(
    "resume_pairs",
    f"{cte('pair_lines')} SELECT run_id, table_id, statement FROM pair_lines WHERE NOT done",
)
def resume_pairs(spark, sf):
    asked = derived(spark, sf, "pair_lines")
    results = asked.filter("done").select("run_id", "table_id", "statement")
    return score.resume_pairs(asked, results).select("run_id", "table_id", "statement")


@query(
    "limit_pairs",
    f"{cte('pair_lines')} SELECT table_id, statement FROM pair_lines ORDER BY table_id, coalesce(type, 'unknown'), statement LIMIT 5",
)
def limited(spark, sf):
    asked = files.default_type(derived(spark, sf, "pair_lines"))
    return order.limit_pairs(asked).select("table_id", "statement")


# --- generated pairs ------------------------------------------------------------

BARE = "trim(regexp_replace(trim(response), '```json|```', '', 'g'))"
RESPONSES = f"""{cte('responses', 'second_responses')},
both_ AS (SELECT * FROM responses UNION ALL SELECT * FROM second_responses),
body AS (SELECT table_id, attempt, CASE WHEN instr(b, '{{') > 1 THEN substr(b, instr(b, '{{')) ELSE b END AS b
         FROM (SELECT *, {BARE} AS b FROM both_)),
parsed AS (SELECT table_id, attempt, CASE WHEN json_valid(b) THEN json_extract(b, '$.pairs') END AS pairs FROM body),
typed AS (SELECT *, json_array_length(pairs) AS n, len(list_distinct(json_extract_string(pairs, '$[*].type'))) AS kinds FROM parsed),
usable AS (SELECT * FROM typed WHERE n > 0 AND (kinds = {len(PAIR_TYPES)} OR attempt = 2)),
accepted AS (SELECT table_id, min(attempt) AS attempt, arg_min(pairs, attempt) AS pairs FROM usable GROUP BY table_id)"""


def _responses(spark, sf) -> DataFrame:
    return derived(spark, sf, "responses").unionByName(derived(spark, sf, "second_responses"))


@query(
    "parse_responses",
    f"{RESPONSES} SELECT table_id, attempt, n AS n_pairs, array_to_string(json_extract_string(pairs, '$[*].statement'), '|') AS statements, "
    "array_to_string(json_extract_string(pairs, '$[*].distractor'), '|') AS distractors, "
    "array_to_string(json_extract_string(pairs, '$[*].type'), '|') AS types FROM typed",
)
def parsed(spark, sf):
    read = pairs.parse_responses(_responses(spark, sf))
    parts = {f"{name}s": F.array_join(F.col(f"pairs.{name}"), "|") for name in ("statement", "distractor", "type")}
    return read.select(
        "table_id", "attempt", F.when(F.col("pairs").isNotNull(), F.size("pairs")).alias("n_pairs"), *[c.alias(k) for k, c in parts.items()]
    )


@query(
    "pair_type_coverage",
    f"{RESPONSES} SELECT table_id, attempt, json_array_length(pairs) AS n_pairs FROM accepted",
)
def accepted(spark, sf):
    found = pairs.accept_attempts(pairs.parse_responses(_responses(spark, sf)))
    return found.select("table_id", "attempt", F.size("pairs").alias("n_pairs"))


@query(
    "failed_tables",
    f"{RESPONSES} SELECT DISTINCT table_id FROM typed WHERE table_id NOT IN (SELECT table_id FROM accepted)",
)
def failed(spark, sf):
    read = stage(pairs.parse_responses(_responses(spark, sf)))
    return pairs.failed_tables(read, pairs.accept_attempts(read))


@query(
    "tag_pairs",
    f"{RESPONSES}, p AS (SELECT table_id, unnest(json_extract(pairs, '$[*]')) AS j FROM accepted) "
    "SELECT table_id, j->>'statement' AS statement, j->>'distractor' AS distractor, j->>'type' AS type FROM p",
)
def tagged(spark, sf):
    return pairs.tag_pairs(pairs.accept_attempts(pairs.parse_responses(_responses(spark, sf))))


def template_sql(spec) -> str:
    return f"""{S.cells(spec)},
lab AS (SELECT table_id, min(i) AS i FROM kept WHERE kind = 'object' GROUP BY table_id),
num AS (SELECT table_id, i, name, row_number() OVER (PARTITION BY table_id ORDER BY i) AS k
        FROM kept WHERE kind IN {S.NUMERIC}),
vals AS (SELECT l.table_id, l.ord, l.cell AS label, a.cell AS a_text, try_cast(a.cell AS DOUBLE) AS av, try_cast(b.cell AS DOUBLE) AS bv, na.name AS a, nb.name AS b
  FROM lab JOIN cell l USING (table_id, i)
  JOIN num na ON na.table_id = l.table_id AND na.k = 1 JOIN num nb ON nb.table_id = l.table_id AND nb.k = 2
  JOIN cell a ON a.table_id = l.table_id AND a.ord = l.ord AND a.i = na.i
  JOIN cell b ON b.table_id = l.table_id AND b.ord = l.ord AND b.i = nb.i
  WHERE l.n_rows >= 2),
whole AS (SELECT table_id, sum(try_cast(a_text AS DECIMAL(28,10))) AS total,
   count(*) FILTER (a_text IS NOT NULL AND NOT coalesce(try_cast(a_text AS DECIMAL(28,10))::DOUBLE = av, false)) AS inexact FROM vals GROUP BY table_id),
facts AS (SELECT table_id, any_value(a) AS a, any_value(b) AS b, max((av, label, a_text)) AS hi, min((av, label, a_text)) AS lo,
   max((bv, label, av, a_text)) AS bhi, min((bv, label, av, a_text)) AS blo FROM vals
   WHERE label IS NOT NULL AND av IS NOT NULL AND bv IS NOT NULL GROUP BY table_id),
uses AS (SELECT table_id, count(*) FILTER (label = hi[2]) AS n_hi, count(*) FILTER (label = lo[2]) AS n_lo, count(*) FILTER (label = bhi[2]) AS n_bhi,
   count(*) FILTER (label = blo[2]) AS n_blo, count(*) FILTER (bv >= bhi[1]) AS n_most FROM vals JOIN facts USING (table_id) GROUP BY table_id),
named AS (SELECT facts.table_id, facts.a, facts.b, hi[2] AS h, hi[3] AS ht, lo[2] AS l, lo[3] AS lt, bhi[2] AS bh, blo[2] AS bl, bhi[4] AS bt, total, inexact,
   hi[1] > lo[1] AS differ, blo[1] < bhi[1] AS spread, CASE WHEN bhi[3] < hi[1] THEN hi[3] ELSE lo[3] END AS ot,
   n_hi, n_lo, n_bhi, n_blo, n_most FROM facts JOIN whole USING (table_id) JOIN uses USING (table_id)),
made AS (
  SELECT table_id, 'lookup' AS type, 'The ' || a || ' of ' || h || ' is ' || ht || '.' AS statement, 'The ' || a || ' of ' || h || ' is ' || lt || '.' AS distractor FROM named WHERE n_hi = 1 AND differ
  UNION ALL SELECT table_id, 'aggregation', 'The total ' || a || ' is ' || regexp_replace(total::VARCHAR, '\\.?0+$', '') || '.',
            'The total ' || a || ' is ' || regexp_replace((total + 1)::VARCHAR, '\\.?0+$', '') || '.' FROM named WHERE inexact = 0 AND total IS NOT NULL
  UNION ALL SELECT table_id, 'comparison', h || ' has a higher ' || a || ' than ' || l || '.', l || ' has a higher ' || a || ' than ' || h || '.' FROM named WHERE n_hi = 1 AND n_lo = 1 AND differ
  UNION ALL SELECT table_id, 'inference', 'The highest ' || b || ' belongs to ' || bh || '.', 'The highest ' || b || ' belongs to ' || bl || '.' FROM named
            WHERE n_bhi = 1 AND n_most = 1 AND n_blo = 1 AND spread
  UNION ALL SELECT table_id, 'multihop', 'The ' || a || ' in the row with the highest ' || b || ' is ' || bt || '.',
            'The ' || a || ' in the row with the highest ' || b || ' is ' || ot || '.' FROM named WHERE n_bhi = 1 AND n_most = 1 AND differ)"""


def _templates(spark, sf, spec):
    p = prepared(spark, sf, spec)
    return pairs.template_pairs(*p)


query("template_pairs", with_(template_sql(EVENT), "SELECT * FROM made"))(
    lambda spark, sf: _templates(spark, sf, EVENT)
)
query("template_pairs_gaps", with_(template_sql(NATION), "SELECT * FROM made"))(
    lambda spark, sf: _templates(spark, sf, NATION)
)

# Pairs beside the table texts they are about.
FANNED = (
    f"{fit_sql(S.positioned(NATION), BUDGET)}, chosen AS (SELECT c.table_id, c.format, c.ord, 0 AS seg FROM costs c "
    f"JOIN fits f USING (table_id, format) WHERE c.ord < f.fit_n), {S.slices('chosen')}, "
    f"{template_sql(S.positioned(NATION))[len(S.cells(S.positioned(NATION))) + 2:]}, "
    "fanned AS (SELECT s.format, m.table_id, statement, distractor, type, text AS table_serialized FROM made m JOIN slice_text s USING (table_id))"
)


def _fanned(spark, sf) -> DataFrame:
    fitted = fit.complete_tables(fit.fit_rows(*prepared(spark, sf, NATION), BUDGET))
    return pairs.fan_out_pairs(_templates(spark, sf, NATION), fitted)


@query("fan_out_pairs", with_(FANNED, "SELECT * FROM fanned"))
def fanned(spark, sf):
    return _fanned(spark, sf)


@query("write_pairs", with_(FANNED, "SELECT format, table_id, statement, table_serialized FROM fanned"))
def write_pairs(spark, sf):
    path = new_folder(spark)
    files.write_pairs(_fanned(spark, sf), path)
    return spark.read.json(path).select("format", "table_id", "statement", "table_serialized")


@query("write_ground_truth", with_(template_sql(EVENT), "SELECT * FROM made"))
def ground_truth(spark, sf):
    path = new_folder(spark)
    files.write_ground_truth(_templates(spark, sf, EVENT), path)
    return spark.read.schema("table_id string, statement string, distractor string, type string").json(path)


@query(
    "check_outputs",
    with_(
        FANNED,
        "SELECT f.format AS artefact, coalesce(n, 0) AS n_lines, e.expected_lines, CASE WHEN coalesce(n, 0) = 0 THEN 'missing or empty' "
        "WHEN n <> e.expected_lines THEN 'wrong number of lines' END AS failure "
        "FROM (SELECT DISTINCT format FROM headers) f LEFT JOIN (SELECT format, count(*) AS n FROM fanned GROUP BY format) USING (format), "
        "(SELECT count(DISTINCT table_id) * 5 AS expected_lines FROM made) e "
        "UNION ALL SELECT 'ground_truth', count(*), NULL, NULL FROM made "
        "UNION ALL SELECT 'clean_tables', count(*), NULL, NULL FROM tabs "
        "UNION ALL SELECT 'completed_ids', count(DISTINCT table_id), NULL, NULL FROM made",
    ),
)
def check(spark, sf):
    made = _templates(spark, sf, NATION)
    tables = prepared(spark, sf, NATION).tables
    others = {"ground_truth": made, "clean_tables": tables, "completed_ids": made.select("table_id").distinct()}
    return checks.check_outputs(_fanned(spark, sf), made.select("table_id").distinct(), others)


@query(
    "generation_prompts",
    with_(
        f"{fit_sql(S.positioned(NATION), BUDGET)}, chosen AS (SELECT c.table_id, c.format, c.ord, 0 AS seg FROM costs c JOIN fits f "
        f"USING (table_id, format) WHERE c.format = 'markdown' AND c.ord < greatest(1, f.fit_n)), {S.slices('chosen')}",
        "SELECT table_id, '" + pairs.PROMPT.replace("'", "''") + "' AS system, "
        "'Table (id=' || table_id || '):' || chr(10) || text || chr(10) || chr(10) || "
        "'Generate 5 statement-distractor pairs.' AS \"user\" FROM slice_text",
    ),
)
def prompts(spark, sf):
    return pairs.generation_prompts(*prepared(spark, sf, NATION), BUDGET).select("table_id", "system", "user")


# --- scores ---------------------------------------------------------------------


@query(
    "score_mask",
    with_(
        f"{FANNED}, m AS (SELECT *, {S.tokens('table_serialized')} AS prefix_len, "
        f"{S.tokens('(table_serialized || chr(10) || statement)')} AS ls, {S.tokens('(table_serialized || chr(10) || distractor)')} AS ld FROM fanned)",
        "SELECT format, table_id, statement, prefix_len, ls AS len_statement, ld AS len_distractor, "
        "greatest(ls, ld) <= 205 AND least(ls, ld) > prefix_len AS scorable FROM m",
    ),
)
def mask(spark, sf):
    counted = score.score_mask(_fanned(spark, sf), max_sequence=205)
    return counted.drop("distractor", "type", "table_serialized")


@query(
    "mean_nll",
    f"{cte('logprobs')} SELECT run_id, pair_id, "
    "round(avg(-logprob) FILTER (side = 'statement' AND pos >= prefix_len), 6) AS nll_statement, "
    "round(avg(-logprob) FILTER (side = 'distractor' AND pos >= prefix_len), 6) AS nll_distractor FROM logprobs GROUP BY run_id, pair_id",
)
def nll(spark, sf):
    found = score.mean_nll(derived(spark, sf, "logprobs"))
    return found.withColumns({c: F.round(c, 6) for c in ["nll_statement", "nll_distractor"]})


RESULTS = f"{cte('scores')}, results AS (SELECT *, nll_statement < nll_distractor AS correct FROM scores WHERE nll_statement IS NOT NULL)"


@query("pair_correct", f"{RESULTS} SELECT * FROM results")
def correct(spark, sf):
    return score.pair_correct(derived(spark, sf, "scores"))


@query(
    "accuracy_summary",
    f"{RESULTS} SELECT run_id, format, t AS type, count(*) FILTER (correct) AS correct, count(*) AS total, "
    "round_even(count(*) FILTER (correct) / count(*), 4)::DOUBLE AS accuracy FROM "
    "(SELECT *, coalesce(type, 'unknown') AS t FROM results) GROUP BY GROUPING SETS ((run_id, format), (run_id, format, t))",
)
def accuracy(spark, sf):
    return score.accuracy_summary(score.pair_correct(derived(spark, sf, "scores")))


RUN_SUMMARY = (
    f"{RESULTS}, asked AS (SELECT run_id, format, count(*) AS n_pairs FROM scores GROUP BY 1, 2), "
    "done AS (SELECT run_id, format, count(*) AS n, count(*) FILTER (correct) AS c FROM results GROUP BY 1, 2) "
    "SELECT run_id, format, n_pairs, coalesce(n, 0) AS n_processed, n_pairs - coalesce(n, 0) AS n_skipped, "
    "coalesce(round_even(c / n, 4), 0)::DOUBLE AS overall_accuracy FROM asked LEFT JOIN done USING (run_id, format)"
)
BY_TYPE = (
    RUN_SUMMARY.replace(" FROM asked LEFT JOIN", ", by_type FROM asked LEFT JOIN")
    + " LEFT JOIN (SELECT run_id, format, string_agg(t || ' ' || c || ' ' || n || ' ' || round_even(c / n, 4)::DOUBLE, ',' ORDER BY t) AS by_type FROM "
    "(SELECT run_id, format, coalesce(type, 'unknown') AS t, count(*) AS n, count(*) FILTER (correct) AS c FROM results GROUP BY ALL) GROUP BY ALL) USING (run_id, format)"
)


@query("write_summary", BY_TYPE)
def summary(spark, sf):
    path = new_folder(spark)
    scores = derived(spark, sf, "scores")
    files.write_summary(score.run_summary(scores, score.pair_correct(scores)), path)
    each = F.transform(
        F.array_sort(F.map_entries("by_type")), lambda e: F.concat_ws(" ", e["key"], e["value"]["correct"], e["value"]["total"], e["value"]["accuracy"])
    )
    return spark.read.schema(files.SUMMARY).json(path).withColumn("by_type", F.array_join(each, ","))


@query("write_results", f"{RESULTS} SELECT run_id, format, type, correct FROM results")
def results(spark, sf):
    path = new_folder(spark)
    files.write_results(score.pair_correct(derived(spark, sf, "scores")), path)
    return files.read_results(spark, path).select("run_id", "format", "type", "correct")


@query(
    "accuracy_across_seeds",
    f"{cte('accuracies')} SELECT format, mode, count(*) AS n_seeds, round(avg(accuracy), 6) AS mean_accuracy, "
    "round(stddev(accuracy), 6) AS std_accuracy, round(avg(accuracy) - 0.5, 6) AS above_chance FROM accuracies GROUP BY format, mode",
)
def across_seeds(spark, sf):
    found = score.accuracy_across_seeds(derived(spark, sf, "accuracies"))
    return found.withColumns({c: F.round(c, 6) for c in ["mean_accuracy", "std_accuracy", "above_chance"]})


# --- sinks ------------------------------------------------------------------------


@query(
    "write_segments",
    with_(
        f"{S.packed(NATION, BUDGET)}, {S.slices('packed')}",
        "SELECT format, chunk, text FROM slice_text JOIN tabs USING (table_id)",
        True,
    ),
)
def write_segments(spark, sf):
    path = new_folder(spark)
    files.write_segments(serialize(prepared(spark, sf, NATION), BUDGET), path)
    return spark.read.schema("text string, format string, chunk int").json(path)


@query(
    "write_clean_tables",
    with_(S.cells(S.positioned(NATION)), "SELECT t.chunk, table_id, ord, string_agg(coalesce(cell, '?'), '|' ORDER BY i) AS cells FROM cell JOIN tabs t USING (table_id) GROUP BY ALL").replace("coalesce(cell, '?')", "coalesce(CASE WHEN kind = 'int_nullable' THEN cell::DOUBLE::BIGINT::VARCHAR ELSE cell END, '?')"),
)
def write_clean(spark, sf):
    path = new_folder(spark)
    p = prepared(spark, sf, NATION)
    own = order.by_position(p.corpus, p.large)
    rows = clean.clean_cells(order.shuffle_rows(own.rows, p.large, own.unique), p.tables, p.large)
    files.write_clean_tables(rows.join(p.tables.select("table_id", "chunk"), "table_id"), path)
    return spark.read.parquet(path).select("chunk", "table_id", "ord", F.array_join("cells", "|", "?").alias("cells"))


@query(
    "candidate_cache",
    with_(
        S.costs(S.positioned(NUMBERS)),
        "SELECT table_id, any_value(n_rows) AS n_rows FROM headers JOIN tabs USING (table_id) GROUP BY table_id "
        f"HAVING max(header) < {SMALL} AND any_value(n_rows) >= 2",
    ),
)
def cache(spark, sf):
    p = prepared(spark, sf, NUMBERS)
    path = new_folder(spark)
    candidates = clean.valid_tables(pack.table_headers(order.by_position(p.corpus), p.tables), SMALL)
    files.candidate_cache(candidates, path)
    return files.candidate_cache(candidates, path).select("table_id", "n_rows")
