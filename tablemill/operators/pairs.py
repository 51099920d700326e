"""Statement and distractor pairs: prompts, generated responses, templates, fan-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablemill.constants import MAX_ATTEMPTS, PAIR_TYPES
from tablemill.functions.tokens import Tokenizer, count_words
from tablemill.operators import fit
from tablemill.operators.order import attach
from tablemill.operators.render import NUMERIC, display_cells, markdown_table, prepare_columns
from tablemill.session import once
from tablemill.sources.corpus import Corpus

PROMPT = (
    "Write five pairs of sentences about the table you are given. In each pair the statement "
    "is true by the table alone and the distractor is the same sentence with a wrong but "
    "plausible value, best taken from elsewhere in the table. Use at most 20 words, and say nothing "
    "about column names, row counts or layout. Write one pair of each type: "
    + ", ".join(PAIR_TYPES)
    + '. Answer with JSON only: {"pairs": [{"statement": "...", "distractor": "...", "type": "..."}]}'
)
PAIR_SCHEMA = "struct<pairs: array<struct<statement: string, distractor: string, type: string>>>"


def _prompts(tables: DataFrame) -> DataFrame:
    """The requests for `(table_id, text)`, the tables as Markdown."""
    user = F.concat(F.lit("Table (id="), F.col("table_id"), F.lit("):\n"), F.col("text"), F.lit("\n\nGenerate 5 statement-distractor pairs."))
    return tables.select("table_id", F.lit(PROMPT).alias("system"), user.alias("user"))


def generation_prompts(
    corpus: Corpus,
    tables: DataFrame,
    large: DataFrame | None,
    budget: int,
    tokenizer: Tokenizer = count_words,
) -> DataFrame:
    """The request for each table, with the Markdown of as many rows as fit, at least one."""
    found = fit.prefix_candidates(corpus, tables, large, budget, tokenizer).filter(
        "format = 'markdown'"
    )
    kept = F.greatest(F.lit(1), F.col("best"))
    found = fit.searched(found, budget, tokenizer)
    return _prompts(found.withColumn("text", markdown_table(F.slice("rows", F.lit(1), kept), F.col("columns"))))


def fitted_prompts(fitted: DataFrame) -> DataFrame:
    """The requests for tables that fit in every format, with the Markdown that was fitted before."""
    return _prompts(fit.complete_tables(fitted).where("format = 'markdown'"))


def parse_responses(responses: DataFrame) -> DataFrame:
    """`(table_id, attempt, pairs)`; `pairs` is NULL where a response cannot be read.

    A response is one JSON object, perhaps fenced or after an introduction. Text after it, a
    second object and single quotes make it unreadable.
    """
    bare = F.trim(F.regexp_replace(F.trim("response"), "```json|```", ""))
    start, body = F.instr("bare", "{"), F.col("body")
    found = once(responses.select("table_id", "attempt", "response"), bare.alias("bare"))
    found = found.select("table_id", "attempt", F.when(start > 1, F.substr("bare", start)).otherwise(F.col("bare")).alias("body"))
    # As the only element of an array: what follows the object is then an error or a second element.
    read = F.from_json(F.concat(F.lit("["), body, F.lit("]")), f"array<{PAIR_SCHEMA}>", {"allowSingleQuotes": "false"})
    # Each response is parsed once, however often its pairs are asked for.
    found = once(found, read.alias("read"), body.startswith("{").alias("is_object"))
    alone = F.when((F.size("read") == 1) & F.col("is_object"), F.get("read", F.lit(0))["pairs"])
    return found.select("table_id", "attempt", alone.alias("pairs"))


def missing_types(pairs: Column) -> Column:
    expected = F.array(*[F.lit(t) for t in PAIR_TYPES])
    return F.array_except(expected, F.transform(pairs, lambda p: p["type"]))


def accept_attempts(parsed: DataFrame, attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """The first attempt with all types, or else a readable last one; one row per table."""
    usable = parsed.filter(
        F.col("pairs").isNotNull()
        & (F.col("attempt") <= attempts)
        & ((F.size(missing_types(F.col("pairs"))) == 0) | (F.col("attempt") == attempts))
        & (F.size("pairs") > 0)
    )
    return usable.groupBy("table_id").agg(
        F.min("attempt").alias("attempt"), F.min_by("pairs", "attempt").alias("pairs")
    )


def failed_tables(parsed: DataFrame, accepted: DataFrame) -> DataFrame:
    return parsed.select("table_id").distinct().join(accepted, "table_id", "left_anti")


def tag_pairs(accepted: DataFrame) -> DataFrame:
    return accepted.select("table_id", F.inline("pairs"))


def fan_out_pairs(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Every pair once per format, beside the table's text in that format."""
    return pairs.join(texts.select("table_id", "format", "text"), "table_id").select(
        "format",
        "table_id",
        "statement",
        "distractor",
        "type",
        F.col("text").alias("table_serialized"),
    )


def template_pairs(
    corpus: Corpus, tables: DataFrame, large: DataFrame | None = None
) -> DataFrame:
    """Pairs from the table itself, without a generator: true statements, false distractors.

    The first text column names the rows, the first two numeric columns a and b give
    values. A pair is made only where it is sure: the rows it speaks of are named by labels that no
    other row has, the values compared differ, a largest value belongs to one row, and a total is
    exact in 28 digits before and 10 after the point. So a table gets up to one pair of each type.
    Two passes with map-side combinable aggregates: the extremes, then how often they occur.
    """
    meta = (
        prepare_columns(tables)
        .withColumn("label_at", F.array_position(F.transform("columns", lambda c: (c["kind"] == "object").cast("int")), 1).cast("int"))
        .withColumn(
            "value_at",
            F.array_compact(
                F.transform(
                    "columns", lambda c, i: F.when(c["kind"].isin(NUMERIC), i + 1)
                )
            ),
        )
        .filter((F.col("label_at") > 0) & (F.size("value_at") >= 2) & (F.col("n_rows") >= 2))
        .select(
            "table_id",
            "columns",
            "label_at",
            F.get("value_at", F.lit(0)).alias("first_at"),
            F.get("value_at", F.lit(1)).alias("second_at"),
        )
    )
    shown = attach(corpus.rows, meta, large).withColumn(
        "cells", display_cells(F.col("cells"), F.col("columns"))
    )

    def cell(at: str) -> Column:
        return F.get("cells", F.col(at) - 1)

    values = shown.select(
        "table_id",
        "n_copies",
        F.get("columns", F.col("label_at") - 1)["name"].alias("label_name"),
        F.get("columns", F.col("first_at") - 1)["name"].alias("a"),
        F.get("columns", F.col("second_at") - 1)["name"].alias("b"),
        cell("label_at").alias("label"),
        cell("first_at").alias("a_text"),
        cell("first_at").try_cast("double").alias("a_value"),
        cell("second_at").try_cast("double").alias("b_value"),
    )
    exact = F.col("a_text").try_cast(EXACT)
    whole = values.groupBy("table_id").agg(
        F.try_sum((exact * F.col("n_copies")).cast(EXACT)).alias("total"),
        # Values that the decimal type doesn't hold exactly.
        F.count_if(F.col("a_text").isNotNull() & ~F.coalesce(exact.cast("double") == F.col("a_value"), F.lit(False))).alias("inexact"),
    )
    named = values.filter("label is not null and a_value is not null and b_value is not null and not isnan(a_value) and not isnan(b_value)")
    top = F.struct("a_value", "label", "a_text")
    second = F.struct("b_value", "label", "a_value", "a_text")
    facts = (
        named.groupBy("table_id", "a", "b")
        .agg(F.max(top).alias("high"), F.min(top).alias("low"), F.max(second).alias("b_high"), F.min(second).alias("b_low"))
        .join(whole, "table_id")
    )
    ends = ("high", "low", "b_high", "b_low")
    narrow = values.select("table_id", "n_copies", "label", "b_value", F.array("label", "a_text").alias("cells"))
    met = attach(narrow, facts.select("table_id", *ends), large)
    uses = met.groupBy("table_id").agg(
        *[F.sum(F.when(F.col("label") == F.col(e)["label"], F.col("n_copies"))).alias(f"n_{e}") for e in ends],
        F.sum(F.when(F.col("b_value") >= F.col("b_high")["b_value"], F.col("n_copies"))).alias("n_most"),
    )
    facts = facts.join(uses, "table_id")

    def sentence(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    def plain(number: Column) -> Column:
        return F.regexp_replace(number.cast("string"), r"\.?0+$", "")

    a, b = F.col("a"), F.col("b")
    high, low, b_high, b_low = (F.col(c) for c in ends)
    one = {e: F.col(f"n_{e}") == 1 for e in ends}
    differ = high["a_value"] > low["a_value"]
    summed = (F.col("inexact") == 0) & F.col("total").isNotNull()
    # The row of the one largest b against another value of a.
    largest = one["b_high"] & (F.col("n_most") == 1)
    other = F.when(b_high["a_value"] < high["a_value"], high["a_text"]).otherwise(low["a_text"])
    made = [
        (
            "lookup", one["high"] & differ,
            sentence("The ", a, " of ", high["label"], " is ", high["a_text"], "."),
            sentence("The ", a, " of ", high["label"], " is ", low["a_text"], "."),
        ),
        (
            "aggregation", summed,
            sentence("The total ", a, " is ", plain(F.col("total")), "."),
            sentence("The total ", a, " is ", plain(F.try_add("total", F.lit(1).cast(EXACT))), "."),
        ),
        (
            "comparison", one["high"] & one["low"] & differ,
            sentence(high["label"], " has a higher ", a, " than ", low["label"], "."),
            sentence(low["label"], " has a higher ", a, " than ", high["label"], "."),
        ),
        (
            "inference", largest & one["b_low"] & (b_low["b_value"] < b_high["b_value"]),
            sentence("The highest ", b, " belongs to ", b_high["label"], "."),
            sentence("The highest ", b, " belongs to ", b_low["label"], "."),
        ),
        (
            "multihop", largest & differ,
            sentence("The ", a, " in the row with the highest ", b, " is ", b_high["a_text"], "."),
            sentence("The ", a, " in the row with the highest ", b, " is ", other, "."),
        ),
    ]
    pairs = F.array_compact(
        F.array(
            *[F.when(sure, F.struct(s.alias("statement"), d.alias("distractor"), F.lit(t).alias("type"))) for t, sure, s, d in made]
        )
    )
    return facts.select("table_id", F.inline(pairs)).filter("statement is not null and distractor is not null")


#: What totals are added in.
EXACT = "decimal(38,10)"
