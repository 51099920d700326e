"""Longest row prefix of a table whose text fits a token budget, per format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablemill.constants import FORMATS, TOKEN_BUDGET
from tablemill.functions.text import let
from tablemill.functions.tokens import FileTokenizer, Tokenizer, count_words
from tablemill.operators.order import by_position, split_keys
from tablemill.operators.pack import costed_rows
from tablemill.operators.render import csv_header, csv_row, render_slice
from tablemill.session import stage
from tablemill.sources.corpus import Corpus


def prefix_candidates(
    corpus: Corpus, tables: DataFrame, large: DataFrame | None, budget: int, tokenizer: Tokenizer, special_tokens: int = 0
) -> DataFrame:
    """`(format, table_id, rows, ords, columns, kv_floats, n_rows)` with the first rows, which could fit.

    Rows come in the tables' own order. Under the word counter `known` has how many of them fit where their words add
    up, and is NULL elsewhere.

    A prefix costs at least its rows, so rows past the budget by that sum alone
    never leave their task. Per table come the rows up to the first one too many,
    and of blank key-value rows, which cost and print nothing, only one at the
    start; so what is gathered is bounded by the budget. A row with anything to print costs
    a token in every format, so rows after more than `budget` such rows aren't even rendered.
    A tokenizer file's own lower bound stands in for its counts, which don't add up.
    """
    counted = tokenizer is count_words
    tokenizer = tokenizer.least if isinstance(tokenizer, FileTokenizer) else tokenizer
    rows = costed_rows(by_position(corpus, large), tables, large, tokenizer, after=budget)
    # The first row of a split is enough to carry what a table's rows share.
    rows = rows.withColumn("columns", F.when(F.col("ord") == 0, F.col("columns")))
    so_far = Window.partitionBy(*split_keys(large)).orderBy("ord")
    costs = [F.get("costs", F.lit(i)) for i in range(len(FORMATS))]
    before_row = F.array(
        *[F.coalesce(F.sum(c).over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for c in costs]
    )
    rows = rows.withColumn("before", before_row)
    if large is not None:
        # A few rows per large table: what the splits before this one add up to.
        earlier = (
            Window.partitionBy("table_id")
            .orderBy("split")
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        totals = (
            rows.join(F.broadcast(large.select("table_id")), "table_id", "left_semi")
            .groupBy("table_id", "split")
            .agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"t{i}") for i, c in enumerate(costs)])
            .select(
                "table_id",
                "split",
                F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"),
                F.array(
                    *[F.coalesce(F.sum(f"t{i}").over(earlier), F.lit(0)) for i in range(len(FORMATS))]
                ).alias("earlier"),
            )
        )
        rows = (
            rows.join(F.broadcast(totals), ["table_id", "split"], "left")
            .withColumn("ord", F.col("ord") + F.coalesce("base", F.lit(0)))
            .withColumn(
                "before",
                F.when(F.col("earlier").isNull(), F.col("before")).otherwise(
                    F.zip_with("before", "earlier", lambda a, b: a + b)
                ),
            )
        )
    needed = F.array(
        *[
            F.when(
                (F.get("before", F.lit(i)) <= budget)
                & ((F.lit(fmt != "keyvalue") | (costs[i] > 0)) | (F.col("ord") == 0)),
                F.lit(fmt),
            )
            for i, fmt in enumerate(FORMATS)
        ]
    )
    best = {}
    if counted:
        # Words of the prefix that ends with a row, if those of all its rows add up.
        head = F.col("heads")
        around = {
            "csv": head[0],
            "json": F.col("ord") + 1,
            "keyvalue": F.lit(0),
            "markdown": head[3],
            "sql_schema": head[4] - head[0] + F.col("ranges"),
        }
        rows = rows.withColumn("needed", needed)
        for i, fmt in enumerate(FORMATS):
            total = F.get("before", F.lit(i)) + costs[i] + around[fmt] + special_tokens
            best[fmt] = F.count_if(F.get("needed", F.lit(i)).isNotNull() & (total <= budget)).cast("int")
        adds = F.bool_and("adds")
    else:
        rows = rows.withColumn("needed", needed)
    gathered = (
        rows.where(F.exists("needed", lambda f: f.isNotNull()))
        .groupBy("table_id")
        .agg(
            F.sort_array(F.collect_list(F.struct("ord", "cells", "needed"))).alias("found"),
            F.first("columns", ignorenulls=True).alias("columns"),
            F.first("kv_floats").alias("kv_floats"),
            F.first("n_rows").alias("n_rows"),
            *([F.when(adds, F.array(*best.values())).alias("known")] if counted else []),
        )
    )
    each = gathered.select("*", F.posexplode(F.array(*[F.lit(f) for f in FORMATS])).alias("__at", "format"))
    each = each.withColumn("found", F.filter("found", lambda r: F.get(r["needed"], F.col("__at")).isNotNull()))
    if counted:
        each = each.withColumn("known", F.get("known", F.col("__at")))
    return (
        each.where(F.size("found") > 0)
        .withColumn("rows", F.transform("found", lambda r: r["cells"]))
        .withColumn("ords", F.transform("found", lambda r: r["ord"]))
        .drop("found", "__at")
    )


# State of the binary search.
SEARCH = "struct<low: int, high: int, best: int>"


def longest_prefix(budget: int, tokenizer: Tokenizer, special_tokens: int = 0) -> Column:
    """Binary search over the gathered rows; 0 if not even the first row fits."""

    def fits(n: Column) -> Column:
        text = render_slice(
            F.col("format"), F.slice("rows", F.lit(1), n), F.col("columns"), F.col("kv_floats")
        )
        return let(text, lambda t: tokenizer(t) + special_tokens <= budget, "boolean")

    def narrow(state: Column, _: Column) -> Column:
        low, high, best = state["low"], state["high"], state["best"]

        def moved(middle: Column) -> Column:
            return let(
                fits(middle),
                lambda ok: F.struct(
                    F.when(ok, middle + 1).otherwise(low).alias("low"),
                    F.when(ok, high).otherwise(middle - 1).alias("high"),
                    F.when(ok, middle).otherwise(best).alias("best"),
                ),
                SEARCH,
            )

        return F.when(low > high, state).otherwise(
            let(F.shiftright(low + high, 1), moved, SEARCH)
        )

    size = F.size("rows")
    steps = F.sequence(F.lit(1), F.ceil(F.log2(size + 1)).cast("int") + 1)
    start = F.struct(F.lit(1).alias("low"), size.alias("high"), F.lit(0).alias("best"))
    return F.aggregate(steps, start, narrow, lambda s: s["best"])


def searched(found: DataFrame, budget: int, tokenizer: Tokenizer, special_tokens: int = 0) -> DataFrame:
    """`found` (from `prefix_candidates`) with `best`, how many of the gathered rows fit."""
    if isinstance(tokenizer, FileTokenizer):
        return _probed(found, budget, tokenizer, special_tokens)
    best = longest_prefix(budget, tokenizer, special_tokens)
    if "known" in found.columns:
        best = F.when(F.col("known").isNotNull(), F.col("known")).otherwise(best)
    return found.withColumn("best", best).drop("known")


def _probed(found: DataFrame, budget: int, tokenizer: FileTokenizer, special_tokens: int) -> DataFrame:
    """`best` by encoding whole prefixes, since counts of a file's tokens don't add up over rows.

    Every round renders one prefix per table and format that is still open and encodes it in Arrow batches. The
    first prefix is all that was gathered; later ones are where the line through the counts known so far
    meets the budget, every third one in the middle. What is decided leaves the rounds, so a search takes a few of
    them and at most about three times the logarithm of its rows. As in any bisection, `best` is a border: it
    fits, and one more row doesn't.
    """
    low, high = F.col("low"), F.col("high")
    first = {"low": F.lit(0), "high": F.size("rows") + 1, "t_low": F.lit(special_tokens), "t_high": F.lit(None).cast("int")}
    waiting, done, turn = stage(found.withColumns(first)), [], 0
    while True:
        done.append(waiting.where(high - low <= 1))
        waiting = waiting.where(high - low > 1)
        if waiting.isEmpty():
            break
        middle = F.shiftright(low + high, 1)
        on_line = low + F.floor((budget - F.col("t_low")) * (high - low) / (F.col("t_high") - F.col("t_low"))).cast("int")
        guess = middle if turn % 3 == 2 else F.when(F.col("t_high").isNull(), high - 1).otherwise(F.coalesce(on_line, middle))
        probed = waiting.withColumn("probe", F.greatest(low + 1, F.least(high - 1, guess)))
        text = render_slice(F.col("format"), F.slice("rows", F.lit(1), F.col("probe")), F.col("columns"), F.col("kv_floats"))
        probed = probed.withColumn("text", text).withColumn("t", tokenizer(F.col("text")) + special_tokens)
        fits = F.col("t") <= budget
        waiting = stage(
            probed.withColumns(
                {
                    "low": F.when(fits, F.col("probe")).otherwise(low),
                    "high": F.when(fits, high).otherwise(F.col("probe")),
                    "t_low": F.when(fits, F.col("t")).otherwise(F.col("t_low")),
                    "t_high": F.when(fits, F.col("t_high")).otherwise(F.col("t")),
                }
            ).drop("probe", "text", "t")
        )
        turn += 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.withColumnRenamed("low", "best").drop("high", "t_low", "t_high")


def fit_rows(
    corpus: Corpus,
    tables: DataFrame,
    large: DataFrame | None = None,
    budget: int = TOKEN_BUDGET,
    tokenizer: Tokenizer = count_words,
    special_tokens: int = 0,
) -> DataFrame:
    """`(table_id, format, fit_n, n_rows, text)` for every table and format.

    `fit_n` 0 and a NULL text mean that nothing fits. With a tokenizer of Column expressions the
    search is one expression; with a tokenizer file it takes rounds of stored tables.
    """
    found = prefix_candidates(corpus, tables, large, budget, tokenizer, special_tokens)
    fitted = searched(found, budget, tokenizer, special_tokens)
    text = render_slice(
        F.col("format"), F.slice("rows", F.lit(1), F.col("best")), F.col("columns"), F.col("kv_floats")
    )
    # The prefix ends before the first row that does not fit; blank rows in between count.
    fit_n = F.when(F.col("best") < F.size("ords"), F.get("ords", F.col("best"))).otherwise(F.col("n_rows"))
    fitted = fitted.select(
        "table_id",
        "format",
        F.when(F.col("best") == 0, 0).otherwise(fit_n).alias("fit_n"),
        F.when(F.col("best") > 0, text).alias("text"),
    )
    # Formats of which not one row fits the budget.
    every = tables.select(
        "table_id", "n_rows", F.explode(F.array(*[F.lit(f) for f in FORMATS])).alias("format")
    )
    return every.join(fitted, ["table_id", "format"], "left").select(
        "table_id", "format", F.coalesce("fit_n", F.lit(0)).alias("fit_n"), "n_rows", "text"
    )


def truncated_rows(fitted: DataFrame) -> DataFrame:
    """Rows kept when cutting a table to the budget: at least one, and all for an SQL schema."""
    kept = F.when(F.col("format") == "sql_schema", F.col("n_rows")).otherwise(
        F.greatest(F.lit(1), F.col("fit_n"))
    )
    return fitted.select("table_id", "format", kept.cast("bigint").alias("n_kept"))


def missing_formats(fitted: DataFrame) -> DataFrame:
    """Tables that do not fit in some format, with those formats; they count as failed."""
    return (
        fitted.groupBy("table_id")
        .agg(F.sort_array(F.collect_list(F.when(F.col("text").isNull(), F.col("format")))).alias("m"))
        .filter(F.size("m") > 0)
        .select("table_id", F.array_join("m", ",").alias("missing"))
    )


def complete_tables(fitted: DataFrame) -> DataFrame:
    return fitted.join(missing_formats(fitted), "table_id", "left_anti")


def schema_free_lines(rows: DataFrame) -> DataFrame:
    """A table without type information as plain CSV, line by line and without a budget.

    `rows` is the result of `costed_rows`. The text has no size limit, so it stays
    one row per line; line 0 is the header.
    """
    lines = rows.select(
        "table_id", (F.col("ord") + 1).alias("line_no"), csv_row(F.col("cells"), F.col("columns")).alias("line")
    )
    headers = rows.filter("ord = 0 and split = 0").select(
        "table_id", F.lit(0).cast("bigint").alias("line_no"), csv_header(F.col("columns")).alias("line")
    )
    return headers.unionByName(lines)
