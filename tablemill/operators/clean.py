"""Cleaning: which columns of each table stay, and what kind of value they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablemill.constants import MAX_CELL_CHARS
from tablemill.operators.order import attach
from tablemill.sources.corpus import Corpus, table_id


def is_artifact(name: Column) -> Column:
    return name.startswith("Unnamed") | (name == "index")


def drop_artifact_columns(tables: DataFrame) -> DataFrame:
    return tables.withColumn("columns", F.filter("columns", lambda c: ~is_artifact(c["name"])))


def value_kind(arrow_type: Column, has_null: Column) -> Column:
    """How values print: integers with gaps print as floats, booleans with gaps as objects."""
    integer = arrow_type.startswith("int") | arrow_type.startswith("uint")
    return (
        F.when(arrow_type == "float", "single")
        .when(arrow_type.isin("double", "halffloat"), "float")
        .when(integer & has_null, "int_nullable")
        .when(integer, "int")
        .when((arrow_type == "bool") & ~has_null, "bool")
        .when(arrow_type == "bool", "bool_object")
        .when(arrow_type.startswith("timestamp"), "time")
        .otherwise("object")
    )


# Tables up to this many columns are profiled without exploding their cells.
NARROW = 64


def column_stats(corpus: Corpus) -> DataFrame:
    """`(table_id, n_rows, stats)`: per column the present values and the longest text.

    Partial aggregation reduces a table to a few rows before the shuffle, so a
    table of any size costs the reducers the same.
    """
    rows = corpus.rows if corpus.plain is None else corpus.plain
    if corpus.width is not None and corpus.width <= NARROW:
        cells = [F.get("cells", F.lit(i)) for i in range(corpus.width)]
        counted = rows.groupBy("table_id").agg(
            F.count(F.lit(1)).alias("n_rows"),
            *[F.count(c).alias(f"valid_{i}") for i, c in enumerate(cells)],
            *[F.max(F.length(c)).alias(f"longest_{i}") for i, c in enumerate(cells)],
        )
        stats = F.array(
            *[
                F.struct(F.col(f"valid_{i}").alias("n_valid"), F.col(f"longest_{i}").alias("longest"))
                for i in range(corpus.width)
            ]
        )
        return counted.select("table_id", "n_rows", stats.alias("stats"))
    return (
        rows.select("table_id", F.posexplode("cells").alias("pos", "cell"))
        .groupBy("table_id", "pos")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count("cell").alias("n_valid"),
            F.max(F.length("cell")).alias("longest"),
        )
        .groupBy("table_id")
        .agg(
            F.max("n").alias("n_rows"),
            F.transform(
                F.sort_array(F.collect_list(F.struct("pos", "n_valid", "longest"))),
                lambda s: F.struct(s["n_valid"].alias("n_valid"), s["longest"].alias("longest")),
            ).alias("stats"),
        )
    )


def _described(corpus: Corpus) -> DataFrame:
    """Tables with every column's kind, counts and the reason it goes, if it does."""

    def described(c: Column) -> Column:
        s = F.get("stats", c["pos"])
        return F.struct(
            c["pos"].alias("pos"),
            c["name"].alias("name"),
            c["arrow_type"].alias("arrow_type"),
            value_kind(c["arrow_type"], s["n_valid"] < F.col("n_rows")).alias("kind"),
            s["n_valid"].alias("n_valid"),
            s["longest"].alias("longest"),
        )

    def judged(c: Column) -> Column:
        reason = (
            F.when(is_artifact(c["name"]), "artifact")
            .when(c["n_valid"] == 0, "all_null")
            .when(
                c["kind"].isin("object", "bool_object") & (c["longest"] > MAX_CELL_CHARS),
                "long_text",
            )
        )
        return c.withField("dropped", reason)

    return corpus.tables.join(column_stats(corpus), "table_id").withColumn(
        "columns", F.transform(F.transform("columns", described), judged)
    )


def column_report(corpus: Corpus) -> DataFrame:
    """One row per column of every table."""
    return _described(corpus).select("table_id", "n_rows", F.inline("columns"))


def _flagged(corpus: Corpus) -> DataFrame:
    """Tables with their columns' kinds and the columns they keep, from masks of their rows' cells.

    What meets of a table's rows are four numbers. All tables have the same columns.
    """
    found = corpus.flags.groupBy("chunk", "member").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.bit_or("present").alias("any"),
        F.bit_and("present").alias("all"),
        F.bit_or("long").alias("long"),
    )
    found = found.withColumn("table_id", table_id(F.col("chunk"), F.col("member"))).where("table_id is not null")
    # Members of different names may share a table.
    same = Window.partitionBy("table_id")
    found = found.withColumns(
        {
            "n_rows": F.sum("n_rows").over(same),
            "any": F.bit_or("any").over(same),
            "all": F.bit_and("all").over(same),
            "long": F.bit_or("long").over(same),
        }
    )

    def has(mask: str, pos: int) -> Column:
        return F.col(mask).bitwiseAND(F.shiftleft(F.lit(1).cast("bigint"), pos)) != 0

    columns = []
    for i, (name, arrow_type) in enumerate(corpus.layout):
        kind = value_kind(F.lit(arrow_type), ~has("all", i))
        stays = ~is_artifact(F.lit(name)) & has("any", i) & ~(kind.isin("object", "bool_object") & has("long", i))
        column = F.struct(F.lit(i).alias("pos"), F.lit(name).alias("name"), F.lit(arrow_type).alias("arrow_type"), kind.alias("kind"))
        columns.append(F.when(stays, column))
    kept = F.array_compact(F.array(*columns))
    return found.select("chunk", "table_id", "member", "n_rows", kept.alias("columns")).where(F.size("columns") > 0)


def clean_tables(corpus: Corpus) -> DataFrame:
    """Tables with the columns they keep; tables without rows or columns drop out."""
    if corpus.flags is not None:
        return _flagged(corpus)
    kept = F.filter("columns", lambda c: c["dropped"].isNull())
    short = F.transform(kept, lambda c: c.dropFields("n_valid", "longest", "dropped"))
    return (
        _described(corpus)
        .select("chunk", "table_id", "member", "n_rows", short.alias("columns"))
        .filter((F.col("n_rows") > 0) & (F.size("columns") > 0))
    )


def clean_cells(rows: DataFrame, tables: DataFrame, large: DataFrame | None = None) -> DataFrame:
    """Rows with only the kept cells, in column order."""
    return attach(rows, tables.select("table_id", "columns"), large).select(
        *[c for c in rows.columns if c != "cells"],
        F.transform("columns", lambda c: F.get("cells", c["pos"])).alias("cells"),
    )


def valid_tables(headers: DataFrame, budget: int) -> DataFrame:
    """Tables with two rows or more whose header fits the budget in every format."""
    return headers.filter((F.col("n_rows") >= 2) & (F.array_max("header_costs") < budget))
