"""Packing rows into token-budgeted segments that repeat their header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablemill.constants import FORMATS, TOKEN_BUDGET
from tablemill.functions.costs import table_words, with_header_costs, with_row_costs
from tablemill.functions.text import built_once
from tablemill.functions.tokens import Tokenizer, count_words, is_blank
from tablemill.operators.order import order_rows, row_order, split_keys
from tablemill.operators.render import display_cells, prepare_columns, render_slice, shown_as_is
from tablemill.operators.scan import (
    ENTRY_SCHEMA,
    REPORT_SCHEMA,
    chain,
    pack_scan,
    summarise,
)
from tablemill.sources.corpus import Corpus

COLUMN = (
    "struct<pos: int, name: string, arrow_type: string, kind: string, csv_name: string, "
    "phrase: string, key: string, sql_type: string>"
)
RANGE_SCHEMA = (
    "format string, table_id string, split int, seg_no bigint, part boolean, "
    "start_ord bigint, end_ord bigint"
)
SEGMENT_SCHEMA = (
    RANGE_SCHEMA + f", rows array<array<string>>, columns array<{COLUMN}>, kv_floats boolean"
)


def costed_rows(
    corpus: Corpus,
    tables: DataFrame,
    large: DataFrame | None,
    tokenizer: Tokenizer = count_words,
    after: int | None = None,
    formats: list[str] | None = None,
) -> DataFrame:
    """Ordered rows with display cells and their costs, in `formats` or all, beside their table's columns.

    `tables` is the result of `clean_tables`. The rows arrive partitioned and
    sorted by (table, split), so only the small side of the join moves. With `after`, rows that
    follow more than so many rows of their split with something to print are left out before
    anything is rendered.
    """
    prepared = prepare_columns(tables).withColumns({"words": table_words(F.col("columns")), "as_is": shown_as_is(F.col("columns"))})
    meta = prepared.select("table_id", "n_rows", "columns", "kv_floats", "words", "as_is")
    if large is not None:
        last = F.coalesce(F.col("n_splits"), F.lit(1)) - 1
        meta = (
            meta.join(F.broadcast(large), "table_id", "left")
            .withColumn("split", F.explode(F.sequence(F.lit(0), last)))
            .drop("n_splits")
        )
    # Columns with long texts are among those that display drops.
    rows = order_rows(corpus.rows, large, corpus.unique, shorten=True, plain=corpus.plain)
    # A merge join keeps the rows where they are and never broadcasts them.
    shown = rows.join(meta.hint("merge"), split_keys(large)).withColumn(
        "cells", F.when(F.col("as_is") == F.size("cells"), F.col("cells")).otherwise(display_cells(F.col("cells"), F.col("columns")))
    ).drop("as_is")
    if after is not None:
        earlier = Window.partitionBy(*split_keys(large)).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
        printed = F.exists("cells", lambda c: c.isNotNull() & ~is_blank(c))
        shown = shown.withColumn("__before", F.coalesce(F.sum(printed.cast("int")).over(earlier), F.lit(0)))
        shown = shown.where(F.col("__before") <= after).drop("__before")
    return with_row_costs(shown, tokenizer, formats)


def first_rows(corpus: Corpus, tables: DataFrame) -> DataFrame:
    """The first row of each table in the corpus's order, as display cells."""
    first = (
        corpus.rows.withColumn("order_key", row_order(corpus.rows))
        .groupBy("table_id")
        .agg(F.min_by("cells", "order_key").alias("cells"))
    )
    return (
        prepare_columns(tables)
        .join(first, "table_id")
        .withColumn("cells", display_cells(F.col("cells"), F.col("columns")))
    )


def table_headers(
    corpus: Corpus, tables: DataFrame, tokenizer: Tokenizer = count_words
) -> DataFrame:
    """Header cost of every table in each format."""
    return with_header_costs(first_rows(corpus, tables), tokenizer).select(
        "chunk", "table_id", "n_rows", "header_costs"
    )


def _with_state(
    rows: DataFrame,
    large: DataFrame | None,
    entry: DataFrame | None,
    headers: DataFrame | None,
    tokenizer: Tokenizer,
    with_rows: bool = False,
) -> DataFrame:
    """Attach to the first row of each split what the scan has to know about it; with rows, also how they are rendered."""
    closed = F.array(*[F.lit(-1)] * len(FORMATS))
    zeros = F.array(*[F.lit(0).cast("bigint")] * len(FORMATS))
    if "heads" in rows.columns:
        own_header = F.col("heads")
    else:
        rows = with_header_costs(rows, tokenizer, "own_header", F.col("ord") == 0)
        own_header = F.col("own_header")
    if headers is not None:
        # Only tables that are cut appear here; their later splits lack the first row.
        rows = rows.join(F.broadcast(headers), "table_id", "left")
        own_header = F.when(F.col("split") == 0, own_header).otherwise(F.col("header_costs"))
    base, last, used, seg_no = F.lit(0).cast("bigint"), F.lit(True), closed, zeros
    if entry is not None:
        rows = rows.join(F.broadcast(entry), ["table_id", "split"], "left")
        base, last = F.coalesce("base", base), F.coalesce("last", last)
        used, seg_no = F.coalesce("used", used), F.coalesce("seg_no", seg_no)
    meta = F.struct(
        own_header.alias("header_costs"),
        base.alias("base"),
        last.alias("last"),
        used.alias("used"),
        seg_no.alias("seg_no"),
        *(["columns", "kv_floats"] if with_rows else []),
    )
    return (
        rows.withColumn("meta", F.when(F.col("ord") == 0, meta))
        .select("table_id", "split", "ord", *(["cells"] if with_rows else []), "costs", "meta")
        .sortWithinPartitions(*split_keys(large), "ord")
    )


def split_entries(
    corpus: Corpus,
    tables: DataFrame,
    large: DataFrame,
    headers: DataFrame,
    budget: int,
    tokenizer: Tokenizer,
    formats: list[str] | None = None,
) -> DataFrame:
    """The packing state in which each split of the large tables is entered."""
    ids = F.broadcast(large.select("table_id"))
    cut = Corpus(
        corpus.tables, corpus.rows.join(ids, "table_id", "left_semi"), corpus.unique
    )
    rows = costed_rows(cut, tables.join(ids, "table_id", "left_semi"), large, tokenizer, formats=formats)
    reports = (
        _with_state(rows, large, None, headers, tokenizer)
        .select("table_id", "split", "costs", "meta")
        .mapInArrow(summarise(budget), REPORT_SCHEMA)
    )
    return (
        reports.repartition("table_id")
        .sortWithinPartitions("table_id", "split")
        .mapInArrow(chain, ENTRY_SCHEMA)
    )


def _scan(
    corpus: Corpus,
    tables: DataFrame,
    large: DataFrame | None,
    budget: int,
    tokenizer: Tokenizer,
    with_rows: bool,
    formats: list[str] | None = None,
) -> DataFrame:
    entry = headers = None
    if large is not None:
        ids = F.broadcast(large.select("table_id"))
        headers = table_headers(
            Corpus(corpus.tables, corpus.rows.join(ids, "table_id", "left_semi"), corpus.unique),
            tables,
            tokenizer,
        ).select("table_id", "header_costs")
        entry = split_entries(corpus, tables, large, headers, budget, tokenizer, formats)
    rows = _with_state(
        costed_rows(corpus, tables, large, tokenizer, formats=formats), large, entry, headers, tokenizer, with_rows
    )
    schema = SEGMENT_SCHEMA if with_rows else RANGE_SCHEMA
    return rows.mapInArrow(pack_scan(budget, with_rows, formats), schema)


def pack_ranges(
    corpus: Corpus,
    tables: DataFrame,
    large: DataFrame | None = None,
    budget: int = TOKEN_BUDGET,
    tokenizer: Tokenizer = count_words,
) -> DataFrame:
    """Row range `[start_ord, end_ord)` of every segment; a NULL `seg_no` is a dropped row."""
    found = _scan(corpus, tables, large, budget, tokenizer, False)
    whole = found.select("format", "table_id", "seg_no", "start_ord", "end_ord")
    if large is None:
        return whole
    merged = (
        found.filter("part")
        .groupBy("format", "table_id", "seg_no")
        .agg(F.min("start_ord").alias("start_ord"), F.max("end_ord").alias("end_ord"))
    )
    return found.filter("not part").select(*whole.columns).unionByName(merged)


def pack_segments(
    corpus: Corpus,
    tables: DataFrame,
    large: DataFrame | None = None,
    budget: int = TOKEN_BUDGET,
    tokenizer: Tokenizer = count_words,
    formats: list[str] | None = None,
) -> DataFrame:
    """Every segment with its rows, not rendered yet, in `formats` or all.

    Segments inside a split come out of the scan complete. Only those that
    cross a border are put together afterwards, and they are few.
    """
    found = _scan(corpus, tables, large, budget, tokenizer, True, formats).filter("seg_no is not null")
    if large is None:
        return found.drop("split", "part")
    pieces = F.sort_array(F.collect_list(F.struct("split", "rows")))
    merged = (
        found.filter("part")
        .groupBy("format", "table_id", "seg_no")
        .agg(
            F.min("start_ord").alias("start_ord"),
            F.max("end_ord").alias("end_ord"),
            F.flatten(F.transform(pieces, lambda p: p["rows"])).alias("rows"),
            F.min_by("columns", "split").alias("columns"),
            F.min_by("kv_floats", "split").alias("kv_floats"),
        )
    )
    whole = found.filter("not part").drop("split", "part")
    return whole.unionByName(merged)


@built_once
def _slice_text() -> Column:
    return render_slice(F.col("format"), F.col("rows"), F.col("columns"), F.col("kv_floats"))


def segment_text(segments: DataFrame) -> DataFrame:
    """Render packed segments; a narrow step on bounded slices."""
    return segments.select(
        "format",
        "table_id",
        "seg_no",
        "start_ord",
        "end_ord",
        (F.col("end_ord") - F.col("start_ord")).alias("n_rows"),
        _slice_text().alias("text"),
    )


def segment_tokens(segments: DataFrame, tokenizer: Tokenizer = count_words) -> DataFrame:
    return segments.withColumn("n_tokens", tokenizer(F.col("text")).cast("int"))


def rows_kept(ranges: DataFrame) -> DataFrame:
    """Rows written and dropped per format."""
    n = F.col("end_ord") - F.col("start_ord")
    kept = F.col("seg_no").isNotNull()
    return ranges.groupBy("format").agg(
        F.sum(F.when(kept, n).otherwise(0)).alias("rows_written"),
        F.sum(F.when(~kept, n).otherwise(0)).alias("rows_dropped"),
        F.count("seg_no").alias("segments"),
    )


def serialize_stats(tables: DataFrame, segments: DataFrame, errors: DataFrame) -> DataFrame:
    """Tables processed, tokens written and members skipped, per format and chunk."""
    tokens = segments.groupBy("format", "table_id").agg(F.sum("n_tokens").alias("tokens"))
    every = tables.select("chunk", "table_id").withColumn(
        "format", F.explode(F.array(*[F.lit(f) for f in FORMATS]))
    )
    skipped = errors.groupBy("chunk").agg(F.count(F.lit(1)).alias("skipped"))
    return (
        every.join(tokens, ["format", "table_id"], "left")
        .groupBy("format", "chunk")
        .agg(
            F.count(F.lit(1)).alias("processed"),
            F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        )
        .join(skipped, "chunk", "left")
        .withColumn("skipped", F.coalesce("skipped", F.lit(0)))
        .select("format", "chunk", "processed", "tokens", "skipped")
    )
