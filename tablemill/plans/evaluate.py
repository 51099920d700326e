"""Held-out tables to evaluation pairs: one plan from the corpus to what is written."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablemill.constants import SAMPLE_SEED, SAMPLE_TABLES, TOKEN_BUDGET
from tablemill.functions.tokens import Tokenizer, count_words
from tablemill.operators import clean, fit, order, pack, pairs, score
from tablemill.plans.serialize import Prepared
from tablemill.session import stage
from tablemill.sources import commits, files


class Chosen(NamedTuple):
    """Sampled tables, their texts in all formats, and the requests for them."""

    prepared: Prepared
    fitted: DataFrame
    prompts: DataFrame


class Outcome(NamedTuple):
    """Pairs, the pairs beside each format's text, and ids: of tables that failed, that have pairs, that are finished."""

    pairs: DataFrame
    fanned: DataFrame
    failed: DataFrame
    accepted: DataFrame
    completed: DataFrame


class Stored(NamedTuple):
    """What the committed batches of a folder hold."""

    pairs: DataFrame
    ground_truth: DataFrame
    clean_tables: DataFrame
    completed: DataFrame


def choose(
    prepared: Prepared,
    completed: DataFrame | None = None,
    budget: int = TOKEN_BUDGET,
    n_tables: int = SAMPLE_TABLES,
    seed: int = SAMPLE_SEED,
    tokenizer: Tokenizer = count_words,
) -> Chosen:
    """Valid tables, a sample of them, less those completed before; only these are fitted.

    The sample is drawn before completed tables leave it, so that a resumed run goes on with the
    same tables. The list of sampled tables is bounded by `n_tables`.
    """
    own = order.by_position(prepared.corpus)
    valid = clean.valid_tables(pack.table_headers(own, prepared.tables, tokenizer), budget)
    sampled = order.sample_tables(valid.select("table_id"), n_tables, seed)
    if completed is not None:
        sampled = score.resume_tables(sampled, completed)
    sampled = F.broadcast(stage(sampled))
    corpus = prepared.corpus._replace(
        rows=prepared.corpus.rows.join(sampled, "table_id", "left_semi"),
        tables=prepared.corpus.tables.join(sampled, "table_id", "left_semi"),
        plain=None,
        flags=None,
    )
    tables = prepared.tables.join(sampled, "table_id", "left_semi")
    large = prepared.large if prepared.large is None else prepared.large.join(sampled, "table_id", "left_semi")
    part = Prepared(corpus, tables, large)
    fitted = stage(fit.fit_rows(*part, budget, tokenizer))
    # A table that doesn't fit in some format is not asked about.
    return Chosen(part, fitted, pairs.fitted_prompts(fitted))


def finish(chosen: Chosen, responses: DataFrame) -> Outcome:
    """Responses `(table_id, attempt, response)` of all attempts to accepted pairs, beside every format's text.

    Failed are tables that don't fit in some format and those without an acceptable response. Finished,
    and not to be asked again, are tables with pairs, those that don't fit, and those that were
    answered without an acceptable response; a table without any response is still open.
    """
    fitting = fit.complete_tables(chosen.fitted).select("table_id").distinct()
    parsed = pairs.parse_responses(responses.join(fitting, "table_id", "left_semi"))
    accepted = stage(pairs.accept_attempts(parsed))
    made = pairs.tag_pairs(accepted)
    ids = accepted.select("table_id")
    failed = chosen.prepared.tables.select("table_id").join(ids, "table_id", "left_anti")
    misfits = fit.missing_formats(chosen.fitted).select("table_id")
    finished = ids.unionByName(pairs.failed_tables(parsed, accepted)).unionByName(misfits).distinct()
    return Outcome(made, pairs.fan_out_pairs(made, chosen.fitted), failed, ids, finished)


def _log(folder: str) -> str:
    return f"{folder}/_committed"


def write(chosen: Chosen, outcome: Outcome, folder: str, batch: str | None = None) -> str:
    """Pairs per format, ground truth, clean tables and finished ids as one batch, whose name is returned.

    A run that stops before the end leaves nothing that `stored` reads; writing a committed batch again does nothing.
    """
    spark = outcome.pairs.sparkSession
    batch = batch or uuid.uuid4().hex
    if batch in commits.committed(spark, _log(folder)):
        return batch
    files.write_pairs(outcome.fanned, f"{folder}/pairs", batch)
    files.write_ground_truth(outcome.pairs, f"{folder}/ground_truth", batch)
    corpus, tables, large = chosen.prepared
    own = order.by_position(corpus, large)
    rows = clean.clean_cells(order.shuffle_rows(own.rows, large, own.unique), tables, large)
    kept = rows.join(outcome.accepted, "table_id", "left_semi").join(tables.select("table_id", "chunk"), "table_id")
    files.write_clean_tables(kept, f"{folder}/clean_tables", batch)
    files.append_completed(outcome.completed, f"{folder}/completed", batch)
    commits.commit(spark, _log(folder), batch)
    return batch


def stored(spark: SparkSession, folder: str) -> Stored:
    """The committed batches of a folder: what to score, and what not to ask again."""
    log = _log(folder)
    truth = "table_id string, statement string, distractor string, type string"
    cells = "table_id string, ord bigint, cells array<string>, chunk int"
    return Stored(
        files.read_pairs(spark, f"{folder}/pairs", log),
        commits.read_batches(spark, f"{folder}/ground_truth", log, truth),
        commits.read_batches(spark, f"{folder}/clean_tables", log, cells, "parquet"),
        files.completed_ids(spark, f"{folder}/completed", log),
    )
