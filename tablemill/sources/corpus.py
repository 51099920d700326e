"""The corpus: many small tables held in two DataFrames.

`tables(chunk, table_id, member, columns)` has one row per table;
`rows(chunk, table_id, seed, row_tag, row_pos, n_copies, cells)` has one row per table
row, or per run of identical rows. `cells[pos]` is canonical text, NULL where
the value is missing. `row_tag` is unique within a table and fixes the shuffled
order, so nothing depends on file order or partitioning. `row_pos` ascends in the table's own
order; it is NULL where the source has no such order.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F, types

from tablemill.constants import MAX_CELL_CHARS
from tablemill.functions.text import arrow_type_name, cell_text, float_text, is_common

# Copies of one row travel in runs of at most this many, so a row repeated
# across a large part of a corpus still spreads over many tasks.
COPIES_PER_RUN = 10_000

# Wider tables have no masks of their cells.
MASK_BITS = 64
# Values whose texts are there if they are, and never long.
SHORT = (types.IntegralType, types.BooleanType, types.DecimalType, types.DateType, types.TimestampType, types.TimestampNTZType)


class Corpus(NamedTuple):
    tables: DataFrame
    rows: DataFrame
    # True if no row stands for more than one copy.
    unique: bool = True
    # The same rows before copies are counted, and their width if all tables share one;
    # profiling reads these and so needs no shuffle of row content.
    plain: DataFrame | None = None
    width: int | None = None
    # The same rows as `(chunk, member, present, long)`: bit masks of the cells that are there and of those
    # above the length limit, told from the source's columns without printing them.
    flags: DataFrame | None = None
    # `(name, arrow_type)` of the columns, if all tables have the same.
    layout: list[tuple[str, str]] | None = None


def table_id(chunk: Column, member: Column) -> Column:
    number = chunk.cast("string")
    padded = F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)
    return F.concat(
        F.lit("chunk"), padded, F.lit("__"), F.replace(member, F.lit("/"), F.lit("__"))
    )


def table_seed(member: Column) -> Column:
    """First eight hex digits of the MD5 of the name before the first `=`."""
    prefix = F.md5(F.substring_index(member, "=", 1).cast("binary"))
    return F.conv(F.substring(prefix, 1, 8), 16, 10).cast("bigint")


def content_tag(cells: Column) -> Column:
    """Digest of a whole row."""
    return F.md5(F.array_join(cells, "\x1f", "\x1e").cast("binary"))


def select_chunks(df: DataFrame, chunks: list[int]) -> DataFrame:
    """Keep some chunks; on data stored by chunk this prunes partitions."""
    return df.filter(F.col("chunk").isin(chunks))


def corpus_from_tables(
    df: DataFrame,
    member: Column,
    chunk: Column,
    columns: list[str] | list[tuple[str, str]] | None = None,
    row_key: list[str] | None = None,
    position: Column | None = None,
) -> Corpus:
    """Read one homogeneous DataFrame as many tables, one per member name.

    With `row_key`, columns that identify a row within its table, rows need no
    shuffle here. Without it the row's content is its tag and identical rows
    are counted, which costs one shuffle but combines copies on the map side.
    `position` is a number that ascends in the table's own order and is unique in it; rows with
    positions need a `row_key`. A single numeric key is a position if none is given.
    `columns` may give `(name, source column)` where the names of a table would clash in `df`.
    """
    named_columns = [c if isinstance(c, tuple) else (c, c) for c in columns or df.columns]
    names = [name for name, _ in named_columns]
    source_types = {f.name: f.dataType for f in df.schema.fields}
    kinds = {name: source_types[src] for name, src in named_columns}
    doubles = [src for name, src in named_columns if isinstance(kinds[name], types.DoubleType)]

    def text(name: str, src: str) -> Column:
        if src in doubles:
            return F.get("__floats", F.lit(doubles.index(src)))
        return cell_text(F.col(f"`{src}`"), kinds[name])

    # One expression prints all floats of a row.
    values = F.array(*[F.col(f"`{src}`") for src in doubles])
    floats = values
    if doubles:
        # Most rows hold common numbers only; the expression for all others is interpreted.
        common = reduce(lambda a, b: a & b, [is_common(F.col(f"`{src}`")) for src in doubles])
        texts = F.array(*[F.col(f"`{src}`").cast("string") for src in doubles])
        floats = F.when(common, texts).otherwise(F.transform(values, lambda v: float_text(v, every=True)))
    cells = F.array(*[text(name, src) for name, src in named_columns])
    layout = F.array(
        *[
            F.struct(
                F.lit(i).alias("pos"),
                F.lit(n).alias("name"),
                F.lit(arrow_type_name(kinds[n])).alias("arrow_type"),
            )
            for i, n in enumerate(names)
        ]
    )
    named = df.withColumns(
        {"__member": member, "__chunk": chunk.cast("int"), "__floats": floats}
    )
    tables = (
        named.select(
            F.col("__chunk").alias("chunk"),
            table_id(F.col("__chunk"), F.col("__member")).alias("table_id"),
            F.col("__member").alias("member"),
        )
        .distinct()
        .withColumn("columns", layout)
    )
    base = [
        F.col("__chunk").alias("chunk"),
        table_id(F.col("__chunk"), F.col("__member")).alias("table_id"),
        table_seed(F.col("__member")).alias("seed"),
    ]
    flags, same = None, [(n, arrow_type_name(kinds[n])) for n in names]
    if len(names) <= MASK_BITS:
        held = [_holds(F.col(f"`{src}`"), kinds[name]) for name, src in named_columns]
        flags = df.select(
            chunk.cast("int").alias("chunk"),
            member.alias("member"),
            _mask([present for present, _ in held]).alias("present"),
            _mask([long for _, long in held]).alias("long"),
        )
    if row_key is not None:
        tag = F.concat_ws("-", *[F.col(k).cast("string") for k in row_key])
        if position is None and len(row_key) == 1 and isinstance(source_types[row_key[0]], types.IntegralType):
            position = F.col(f"`{row_key[0]}`")
        placed = F.lit(None) if position is None else position
        rows = named.select(
            *base, tag.alias("row_tag"), placed.cast("bigint").alias("row_pos"), F.lit(1).alias("n_copies"), cells.alias("cells")
        )
        return Corpus(tables, rows, True, rows, len(names), flags, same)
    plain = named.select(*base, cells.alias("cells"))
    return Corpus(tables, count_copies(plain), False, plain, len(names), flags, same)


def _holds(value: Column, kind: types.DataType) -> tuple[Column, Column | None]:
    """Whether the cell of a value is there, and whether it is above the length limit, if it can be."""
    if isinstance(kind, (types.DoubleType, types.FloatType)):
        return value.isNotNull() & ~F.isnan(value), None
    if isinstance(kind, types.StringType):
        return value.isNotNull(), F.length(value) > MAX_CELL_CHARS
    if isinstance(kind, SHORT):
        return value.isNotNull(), None
    text = cell_text(value, kind)
    return text.isNotNull(), F.length(text) > MAX_CELL_CHARS


def _mask(bits: list[Column | None]) -> Column:
    """Bit `i` is set where `bits[i]` is true."""
    one = F.lit(1).cast("bigint")
    terms = [F.when(bit, F.shiftleft(one, i)).otherwise(F.lit(0).cast("bigint")) for i, bit in enumerate(bits) if bit is not None]
    return reduce(lambda a, b: a.bitwiseOR(b), terms, F.lit(0).cast("bigint"))


def count_copies(rows: DataFrame) -> DataFrame:
    """Tag rows by content and turn identical rows into runs."""
    counted = (
        rows.withColumn("row_tag", content_tag(F.col("cells")))
        .groupBy("chunk", "table_id", "seed", "row_tag", "cells")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    runs = F.sequence(F.lit(0), F.expr(f"(copies - 1) div {COPIES_PER_RUN}"))
    return counted.withColumn("run", F.explode(runs)).select(
        "chunk",
        "table_id",
        "seed",
        F.concat_ws("-", "row_tag", "run").alias("row_tag"),
        F.lit(None).cast("bigint").alias("row_pos"),
        F.least(F.lit(COPIES_PER_RUN), F.col("copies") - F.col("run") * COPIES_PER_RUN)
        .cast("int")
        .alias("n_copies"),
        "cells",
    )
