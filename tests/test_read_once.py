"""Expensive expressions are evaluated once for each row, and listings are read once."""

from __future__ import annotations

from tablemill.catalog.derived import derived
from tablemill.operators import pairs, runs


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_response_is_parsed_once(spark):
    rows = spark.createDataFrame([("a", 1, '{"pairs": []}')], "table_id string, attempt int, response string")
    taken = pairs.accept_attempts(pairs.parse_responses(rows))
    assert optimized(taken).count("from_json") == 1


def test_a_path_is_built_once(spark):
    made = optimized(derived(spark, "/root/testdata/sf0.001", "paths"))
    assert made.count("tabular-") == 1


def test_iters_are_those_of_the_chosen_directory(spark):
    rows = [("scratch", "e", d, i) for d, i in [("e/n/checkpoints", 9), ("e/checkpoints", 2), ("e/checkpoints", 1), ("e/checkpoints", 2), ("e", 5)]]
    dirs = spark.createDataFrame(rows + [("store", "f", "f/checkpoints", None)], "location string, exp string, ckpt_dir string, iter bigint")
    found = runs.checkpoint_iters(dirs)
    assert {tuple(r) for r in found.selectExpr("location", "exp", "ckpt_dir", "get(iters, 0)", "latest_iter", "n_iters").collect()} == {
        ("scratch", "e", "e/checkpoints", 1, 2, 2), ("store", "f", "f/checkpoints", None, None, 0)
    }
    # The listing stands once in the plan.
    assert optimized(found).count("LogicalRDD") == 1
