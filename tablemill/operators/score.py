"""Scoring: resume, mean loss of hypothesis tokens, accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablemill.constants import MAX_SEQUENCE
from tablemill.functions.tokens import Tokenizer, count_words


def resume_tables(selected: DataFrame, completed: DataFrame) -> DataFrame:
    return selected.join(completed.select("table_id"), "table_id", "left_anti")


def resume_pairs(pairs: DataFrame, results: DataFrame) -> DataFrame:
    """Pairs of a run that have no result yet."""
    return pairs.join(results, ["run_id", "table_id", "statement"], "left_anti")


def score_mask(
    pairs: DataFrame, tokenizer: Tokenizer = count_words, max_sequence: int = MAX_SEQUENCE
) -> DataFrame:
    """Token counts of table text and of both continuations, and whether the pair can be scored."""

    def full(side: str):
        return F.concat(F.col("table_serialized"), F.lit("\n"), F.col(side))

    joined = pairs.withColumns({"__s": full("statement"), "__d": full("distractor")})
    counted = joined.withColumns(
        {
            "prefix_len": tokenizer(F.col("table_serialized")).cast("int"),
            "len_statement": tokenizer(F.col("__s")).cast("int"),
            "len_distractor": tokenizer(F.col("__d")).cast("int"),
        }
    ).drop("__s", "__d")
    shortest = F.least("len_statement", "len_distractor")
    longest = F.greatest("len_statement", "len_distractor")
    return counted.withColumn(
        "scorable", (longest <= max_sequence) & (shortest > F.col("prefix_len"))
    )


def mean_nll(logprobs: DataFrame) -> DataFrame:
    """Mean negative log-probability of the tokens after the prefix, per pair and side.

    `logprobs(run_id, pair_id, side, pos, prefix_len, logprob)`: one row per token.
    """
    hypothesis = F.when(F.col("pos") >= F.col("prefix_len"), -F.col("logprob"))
    return logprobs.groupBy("run_id", "pair_id").agg(
        F.avg(F.when(F.col("side") == "statement", hypothesis)).alias("nll_statement"),
        F.avg(F.when(F.col("side") == "distractor", hypothesis)).alias("nll_distractor"),
    )


def pair_correct(scores: DataFrame) -> DataFrame:
    """A pair is right if the statement is strictly more likely; unscored pairs drop out."""
    return scores.filter("nll_statement is not null and nll_distractor is not null").withColumn(
        "correct", F.col("nll_statement") < F.col("nll_distractor")
    )


def accuracy_summary(results: DataFrame) -> DataFrame:
    """Correct, total and accuracy per run and format, overall (`type` NULL) and by type."""
    typed = results.withColumn("type", F.coalesce("type", F.lit("unknown")))
    return (
        typed.groupingSets(
            [["run_id", "format"], ["run_id", "format", "type"]], "run_id", "format", "type"
        )
        .agg(
            F.count_if("correct").alias("correct"),
            F.count(F.lit(1)).alias("total"),
        )
        .withColumn("accuracy", F.bround(F.col("correct") / F.col("total"), 4))
    )


def run_summary(pairs: DataFrame, results: DataFrame) -> DataFrame:
    """One row per run and format: pairs, processed, skipped, accuracy, and a map by type."""
    done = accuracy_summary(results)
    overall = done.filter("type is null").drop("type")
    by_type = (
        done.filter("type is not null")
        .groupBy("run_id", "format")
        .agg(
            F.map_from_entries(
                F.sort_array(F.collect_list(F.struct("type", F.struct("correct", "total", "accuracy"))))
            ).alias("by_type")
        )
    )
    asked = pairs.groupBy("run_id", "format").agg(F.count(F.lit(1)).alias("n_pairs"))
    keys = ["run_id", "format"]
    return (
        asked.join(overall, keys, "left")
        .join(by_type, keys, "left")
        .select(
            *keys,
            "n_pairs",
            F.coalesce("total", F.lit(0)).alias("n_processed"),
            (F.col("n_pairs") - F.coalesce("total", F.lit(0))).alias("n_skipped"),
            F.coalesce("accuracy", F.lit(0.0)).alias("overall_accuracy"),
            "by_type",
        )
    )


def accuracy_across_seeds(accuracies: DataFrame) -> DataFrame:
    """Mean and standard deviation over seeds, with the distance from chance."""
    return accuracies.groupBy("format", "mode").agg(
        F.count(F.lit(1)).alias("n_seeds"),
        F.avg("accuracy").alias("mean_accuracy"),
        F.stddev("accuracy").alias("std_accuracy"),
        (F.avg("accuracy") - 0.5).alias("above_chance"),
    )
