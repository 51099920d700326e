"""Inputs of the evaluation and training queries, derived row by row from driver tables.

The expressions mean the same to Spark and to the SQL used for comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablemill.catalog.corpora import dealt, source
from tablemill.constants import FORMATS, PAIR_TYPES


def pick(number: str, values: list[str]) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {number} {cases} END"


def text(number: str) -> str:
    return f"CAST({number} AS STRING)"


def one_pair(kind: str) -> str:
    return (
        f"'{{\"statement\": \"s {kind} ', {text('c_custkey')}, '\", \"distractor\": \"d {kind} ', "
        f"{text('c_custkey')}, '\", \"type\": \"{kind}\"}}'"
    )


ALL_PAIRS = "concat('{\"pairs\": [', " + ", ', ', ".join(one_pair(k) for k in PAIR_TYPES) + ", ']}')"
SOME_PAIRS = "concat('{\"pairs\": [', " + ", ', ', ".join(one_pair(k) for k in PAIR_TYPES[:3]) + ", ']}')"


def response(variant: str) -> str:
    return (
        f"CASE {variant} WHEN 0 THEN {ALL_PAIRS} "
        f"WHEN 1 THEN concat('```json ', {ALL_PAIRS}, ' ```') "
        f"WHEN 2 THEN concat('Here are the pairs: ', {ALL_PAIRS}) "
        f"WHEN 3 THEN {SOME_PAIRS} "
        f"WHEN 4 THEN left({ALL_PAIRS}, 50) WHEN 5 THEN '{{\"pairs\": []}}' "
        f"WHEN 6 THEN concat({ALL_PAIRS}, ' I hope this helps.') WHEN 7 THEN concat({ALL_PAIRS}, {ALL_PAIRS}) "
        f"WHEN 8 THEN replace({ALL_PAIRS}, '\"', chr(39)) ELSE concat({ALL_PAIRS}, ', ', {ALL_PAIRS}) END"
    )


SIX = [*FORMATS, "xml"]
FEW = [f for f in SIX if f != "json"]
EXP = (
    f"concat('tabular-', {pick('o_custkey % 6', SIX)}, '-1p5b', "
    f"CASE WHEN o_custkey % 4 = 0 THEN '' ELSE concat('-seed', {text('o_custkey % 3')}) END, "
    f"'-', {text('2590000 + o_custkey')})"
)
DIR = (
    "CASE WHEN o_custkey % 5 < 3 THEN concat(exp, '/checkpoints') WHEN o_custkey % 5 = 3 THEN exp "
    "ELSE concat(exp, '/', exp, '/checkpoints') END"
)

# name -> source (a driver table or an earlier entry) and columns
DERIVED: dict[str, tuple[str, list[tuple[str, str]]]] = {
    "id_lines": (
        "events",
        [("value", f"CASE WHEN event_type = 'error' THEN '  ' ELSE concat(' u', {text('user_id')}, ' ') END")],
    ),
    "pair_lines": (
        "orders",
        [
            ("run_id", "o_orderstatus"),
            ("format", pick("o_custkey % 5", FORMATS)),
            ("table_id", f"concat('c', {text('o_custkey')})"),
            ("statement", f"concat('order ', {text('o_orderkey')})"),
            ("distractor", f"concat('order ', {text('o_orderkey + 1')})"),
            ("type", f"nullif({pick('o_orderkey % 5', PAIR_TYPES)}, 'multihop')"),
            ("done", "o_orderkey % 3 = 0"),
        ],
    ),
    "responses": (
        "customer",
        [
            ("table_id", f"concat('t', {text('c_custkey')})"),
            ("attempt", "1"),
            ("response", response("c_custkey % 10")),
        ],
    ),
    "second_responses": (
        "customer",
        [
            ("table_id", f"concat('t', {text('c_custkey')})"),
            ("attempt", "2"),
            ("response", response("(c_custkey + c_nationkey) % 10")),
        ],
    ),
    "logprobs": (
        "lineitem",
        [
            ("run_id", "l_returnflag"),
            ("pair_id", "l_orderkey"),
            ("side", "CASE l_linestatus WHEN 'F' THEN 'statement' ELSE 'distractor' END"),
            ("pos", "l_linenumber"),
            ("prefix_len", "3"),
            ("logprob", "-l_extendedprice / 7919"),
        ],
    ),
    "scores": (
        "lineitem",
        [
            ("run_id", "l_returnflag"),
            ("format", pick("l_suppkey % 5", FORMATS)),
            ("type", f"nullif({pick('l_linenumber % 5', PAIR_TYPES)}, 'lookup')"),
            ("nll_statement", "nullif(l_discount, 0.1)"),
            ("nll_distractor", "l_tax"),
        ],
    ),
    "accuracies": (
        "orders",
        [
            ("format", pick("o_custkey % 5", FORMATS)),
            ("mode", "CASE WHEN o_orderstatus = 'F' THEN 'final' ELSE 'matched' END"),
            ("accuracy", "o_totalprice / 500000"),
        ],
    ),
    "order_exps": ("orders", [("o_orderkey", "o_orderkey"), ("o_custkey", "o_custkey"), ("exp", EXP)]),
    "exp_dirs": (
        "order_exps",
        [("o_orderkey", "o_orderkey"), ("o_custkey", "o_custkey"), ("exp", "exp"), ("dir", DIR)],
    ),
    "paths": (
        "exp_dirs",
        [
            ("location", "CASE WHEN o_orderkey % 3 = 0 THEN 'store' ELSE 'scratch' END"),
            (
                "path",
                "CASE WHEN o_orderkey % 17 = 0 OR o_custkey % 13 = 5 THEN concat(exp, '/logs/out') ELSE concat(dir, '/iter_', "
                f"lpad({text('(o_orderkey % 30) * 1000')}, 7, '0')) END",
            ),
        ],
    ),
    # Experiments of all formats but one.
    "few_exps": ("orders", [("o_orderkey", "o_orderkey"), ("exp", EXP.replace(pick("o_custkey % 6", SIX), pick("o_custkey % 5", FEW)))]),
    "few_paths": (
        "few_exps",
        [("location", "'scratch'"), ("path", f"concat(exp, '/checkpoints/iter_', lpad({text('(o_orderkey % 30) * 1000')}, 7, '0'))")],
    ),
    "markers": (
        "customer",
        [
            ("location", "'scratch'"),
            ("o_custkey", "c_custkey"),
            ("value", f"CASE WHEN c_custkey % 7 = 0 THEN 'bad' ELSE concat(' ', {text('c_custkey * 10')}, ' ') END"),
        ],
    ),
    "states": (
        "customer",
        [
            ("jobid", text("2590000 + c_custkey * 2")),
            ("state", "CASE WHEN c_nationkey % 2 = 0 THEN 'COMPLETED' ELSE 'TIMEOUT' END"),
        ],
    ),
    "doc_shards": (
        "documents",
        [
            ("format", pick("doc_id % 5", FORMATS)),
            ("shard", f"concat('train_', lpad({text('doc_id % 28')}, 5, '0'))"),
            ("n_chars", "n_chars"),
        ],
    ),
    "event_points": (
        "events",
        [
            ("format", pick("user_id % 5", FORMATS)),
            ("run", f"concat('r', {text('user_id')})"),
            ("seq", "event_id"),
            ("step", "CAST(event_id % 5000 * 7 AS DOUBLE)"),
            ("loss", "value / 7.919"),
        ],
    ),
    "scalars": (
        "events",
        [
            ("path", f"concat('runs/tabular-', {pick('user_id % 6', SIX)}, '-1p5b-1/events.', {text('user_id')})"),
            ("tag", "CASE WHEN user_id % 3 = 0 AND event_type = 'click' THEN 'LM loss' WHEN event_type = 'view' THEN 'val loss' "
                    "WHEN event_type = 'error' THEN 'loss-scale' ELSE event_type END"),
            ("tag_pos", "length(event_type)"),
            ("step", "event_id"),
            ("value", "value"),
        ],
    ),
}


def derived(spark: SparkSession, sf: str, name: str) -> DataFrame:
    below, columns = DERIVED[name]
    if below in DERIVED:
        lower = derived(spark, sf, below)
        # What is built on is made once for each row, not for each of its uses.
        df = lower.select(F.inline(F.array(F.struct(*lower.columns))))
    else:
        df = dealt(source(spark, sf, below))
    return df.select(*[F.expr(e).alias(n) for n, e in columns])


def cte(*names: str) -> str:
    """The same inputs as common table expressions, with what they build on."""
    order: list[str] = []

    def visit(name: str) -> None:
        below = DERIVED[name][0]
        if below in DERIVED:
            visit(below)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    parts = []
    for name in order:
        below, columns = DERIVED[name]
        chosen = ", ".join(f"{e} AS {n}" for n, e in columns)
        parts.append(f"{name} AS (SELECT {chosen} FROM {below})")
    return "WITH " + ",\n".join(parts)
