"""Deterministic row order and sampling, by hash instead of a random generator.

A table larger than a share of the corpus is cut into splits by ranges of the
ordering hash. Splits are of even size, they can be sorted and packed by
different tasks, and their concatenation is the table's order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablemill.constants import MAX_CELL_CHARS
from tablemill.sources.corpus import COPIES_PER_RUN, Corpus, content_tag

# A table is cut when it holds more rows than SPLIT_ROWS and more than one
# part in MAX_LARGE of the corpus. So at most MAX_LARGE tables are ever cut, and the list
# of them can be broadcast whatever the size of the corpus.
SPLIT_ROWS = 1_000_000
MAX_LARGE = 100_000


def order_key(seed: Column, row_tag: Column) -> Column:
    return F.md5(F.concat_ws("-", seed, row_tag).cast("binary"))


def large_tables(tables: DataFrame, split_rows: int = SPLIT_ROWS) -> DataFrame | None:
    """`(table_id, n_splits)` of the tables to cut, or None if there are none."""
    total, largest = tables.agg(F.sum("n_rows"), F.max("n_rows")).first()
    if total is None:
        return None
    limit = max(split_rows, math.ceil(total / MAX_LARGE))
    if largest <= limit:
        return None
    return tables.filter(F.col("n_rows") > limit).select(
        "table_id", F.ceil(F.col("n_rows") / limit).cast("int").alias("n_splits")
    )


def split_keys(large: DataFrame | None) -> list[str]:
    """What rows are partitioned by: a constant split would only hide that tables are whole."""
    return ["table_id"] if large is None else ["table_id", "split"]


def by_position(corpus: Corpus, large: DataFrame | None = None) -> Corpus:
    """The corpus in the tables' own order instead of the shuffled one.

    Large tables are cut by even ranges of position. Rows without a position raise an error
    when they are read.
    """
    missing = F.raise_error(F.lit("a row has no position: give the corpus an order column"))
    position = F.when(F.col("row_pos").isNull(), missing.cast("bigint")).otherwise(F.col("row_pos"))
    # Hexadecimal digits sort as numbers once negative ones are moved below the others.
    digits = F.lpad(F.hex(position.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    rows = corpus.rows.withColumns({"order_key": digits, "order_share": F.lit(0).cast("bigint")})
    if large is not None:
        ends = (
            corpus.rows.join(F.broadcast(large.select("table_id")), "table_id", "left_semi")
            .groupBy("table_id")
            .agg(F.min("row_pos").alias("__low"), F.max("row_pos").alias("__high"))
        )
        place = (F.col("row_pos") - F.col("__low")) / (F.col("__high") - F.col("__low") + 1)
        rows = rows.join(F.broadcast(ends), "table_id", "left").withColumn(
            "order_share", F.coalesce(F.floor(place * (1 << 32)).cast("bigint"), F.lit(0))
        )
        rows = rows.drop("__low", "__high")
    return corpus._replace(rows=rows)


def row_order(rows: DataFrame) -> Column:
    """What rows are ordered by: the key that `by_position` gave them, or the seeded hash."""
    return F.col("order_key") if "order_key" in rows.columns else order_key(F.col("seed"), F.col("row_tag"))


def short_cells(cells: Column) -> Column:
    """Cells with texts above the length limit left blank."""
    cut = F.transform(cells, lambda c: F.when(F.length(c) > MAX_CELL_CHARS, F.lit("")).otherwise(c))
    # A row that is short as a whole has no long cell.
    return F.when(F.length(F.array_join(cells, "", "")) <= MAX_CELL_CHARS, cells).otherwise(cut)


def place_rows(rows: DataFrame, large: DataFrame | None, shorten: bool = False) -> DataFrame:
    """Give every row its ordering key and the split it belongs to.

    With `shorten`, for callers that drop columns with texts above the length limit, such a
    text is not carried through the shuffle.
    """
    cells = short_cells(F.col("cells")) if shorten else F.col("cells")
    share = F.conv(F.substring("order_key", 1, 8), 16, 10).cast("bigint")
    if "order_share" in rows.columns:
        share = F.col("order_share")
    placed = rows.select(
        "table_id",
        row_order(rows).alias("order_key"),
        *[c for c in rows.columns if c == "order_share"],
        "n_copies",
        cells.alias("cells"),
    )
    if large is None:
        return placed.withColumn("split", F.lit(0))
    split = F.when(
        F.col("n_splits").isNotNull(),
        F.shiftright(share * F.col("n_splits"), 32).cast("int"),
    ).otherwise(0)
    return (
        placed.join(F.broadcast(large), "table_id", "left")
        .withColumn("split", split)
        .drop("n_splits")
    )


def _numbered_copies(plain: DataFrame, shorten: bool) -> DataFrame:
    """Rows with the ordering keys of `count_copies`, numbered where their table is whole: one shuffle, by table."""
    cells = short_cells(F.col("cells")) if shorten else F.col("cells")
    tag = F.lit(None).cast("string")
    if shorten:
        # The tag is that of the full cells, so rows that lose some take theirs along.
        tag = F.when(F.length(F.array_join("cells", "", "")) > MAX_CELL_CHARS, content_tag(F.col("cells")))
    moved = plain.select("table_id", "seed", cells.alias("cells"), tag.alias("__tag")).repartition("table_id")
    tagged = moved.withColumn("row_tag", F.coalesce("__tag", content_tag(F.col("cells")))).drop("__tag")
    equal = Window.partitionBy("table_id", "row_tag", "cells").orderBy("row_tag")
    numbered = tagged.withColumn("copy", F.row_number().over(equal))
    run = F.expr(f"(copy - 1) div {COPIES_PER_RUN}")
    return numbered.select(
        "table_id",
        F.lit(0).alias("split"),
        order_key(F.col("seed"), F.concat_ws("-", "row_tag", run)).alias("order_key"),
        "copy",
        "cells",
    )


def order_rows(
    rows: DataFrame, large: DataFrame | None, unique: bool, shorten: bool = False, plain: DataFrame | None = None
) -> DataFrame:
    """Rows of each split in order; `ord` counts from 0 within the split.

    One shuffle by (table, split) serves the sort, the numbering and whatever
    scan follows. So it does for rows with copies if no table is cut and `plain` has them before they were counted.
    """
    keys = split_keys(large)
    if not unique and large is None and plain is not None and "order_key" not in rows.columns:
        by_key = Window.partitionBy(*keys).orderBy("order_key", "copy")
        numbered = (F.row_number().over(by_key) - 1).cast("bigint").alias("ord")
        return _numbered_copies(plain, shorten).select("table_id", "split", numbered, "cells")
    placed = place_rows(rows, large, shorten)
    copy = F.lit(0)
    if not unique:
        placed = placed.repartition(*keys).withColumn(
            "copy", F.explode(F.sequence(F.lit(1), F.col("n_copies")))
        )
        copy = F.col("copy")
    by_key = Window.partitionBy(*keys).orderBy("order_key", copy)
    return placed.select(
        "table_id",
        "split",
        (F.row_number().over(by_key) - 1).cast("bigint").alias("ord"),
        "cells",
    )


def attach(rows: DataFrame, per_table: DataFrame, large: DataFrame | None) -> DataFrame:
    """Join rows with one row per table; the rows of a large table spread over its splits."""
    if large is None:
        return rows.join(per_table, "table_id")
    cuts = F.broadcast(large)
    pieces = F.coalesce("n_splits", F.lit(1))
    spread = (
        rows.join(cuts, "table_id", "left")
        .withColumn("__piece", F.pmod(F.hash("cells"), pieces).cast("int"))
        .drop("n_splits")
    )
    copies = (
        per_table.join(cuts, "table_id", "left")
        .withColumn("__piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
        .drop("n_splits")
    )
    return spread.join(copies, ["table_id", "__piece"]).drop("__piece")


def split_bases(rows: DataFrame, large: DataFrame) -> DataFrame:
    """First position of every split of the large tables; at most two rows per limit-sized piece."""
    before = (
        Window.partitionBy("table_id")
        .orderBy("split")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        place_rows(rows.join(F.broadcast(large.select("table_id")), "table_id", "left_semi"), large)
        .groupBy("table_id", "split")
        .agg(F.sum("n_copies").alias("n"))
        .select(
            "table_id", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
        )
    )


def shuffle_rows(rows: DataFrame, large: DataFrame | None, unique: bool, plain: DataFrame | None = None) -> DataFrame:
    """`(table_id, ord, cells)` with `ord` the position in the whole table; see `order_rows` for `plain`."""
    ordered = order_rows(rows, large, unique, plain=plain)
    if large is None:
        return ordered.drop("split")
    return ordered.join(
        F.broadcast(split_bases(rows, large)), ["table_id", "split"], "left"
    ).select("table_id", (F.col("ord") + F.coalesce("base", F.lit(0))).alias("ord"), "cells")


def sorted_members(tables: DataFrame) -> DataFrame:
    """Position of every member within its archive, by name."""
    by_name = Window.partitionBy("chunk").orderBy("member")
    return tables.select("chunk", "member", F.row_number().over(by_name).alias("n"))


def sample_tables(tables: DataFrame, n: int, seed: int) -> DataFrame:
    """A seeded sample without replacement: a top-k by hash, never a full sort."""
    draw = F.md5(F.concat_ws("-", F.lit(seed), "table_id").cast("binary"))
    return tables.withColumn("__draw", draw).orderBy("__draw", "table_id").limit(n).drop("__draw")


def limit_pairs(pairs: DataFrame, n: int = 5) -> DataFrame:
    return pairs.orderBy("table_id", "type", "statement").limit(n)
