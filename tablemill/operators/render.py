"""The five text formats, for one row (token costs) and for a slice of rows (text).

A slice is an array of rows, a row an array of display cells, and `columns` an
array of structs that carry name, kind and the per-column text that is
worth preparing once per table. Slices are bounded by the token budget.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tablemill.constants import SPACES
from tablemill.functions.text import csv_quote, float_text, json_string, let, six_digits, three_digits
from tablemill.functions.tokens import is_blank

NUMERIC = ["int", "int_nullable", "float", "single"]
FLOATING = ["int_nullable", "float", "single"]

# How the timestamps of one column print in a slice of CSV.
DATE, PLAIN, MILLI, MICRO = "date", "plain", "milli", "micro"


def sql_type(arrow_type: Column) -> Column:
    return (
        F.when(arrow_type.isin("double", "float", "float32", "float64"), "FLOAT")
        .when(arrow_type.startswith("int"), "INT")
        .otherwise("VARCHAR")
    )


def prepare_columns(tables: DataFrame) -> DataFrame:
    """Add per-column text and the number rule of key-value rows to each table.

    In a table of numbers only, with a floating column among them, whole numbers
    print as floats in key-value rows.
    """
    floats = F.forall("columns", lambda c: c["kind"].isin(NUMERIC)) & F.exists(
        "columns", lambda c: c["kind"].isin(FLOATING)
    )

    def prepared(c: Column) -> Column:
        return F.struct(
            c["pos"].alias("pos"),
            c["name"].alias("name"),
            c["arrow_type"].alias("arrow_type"),
            c["kind"].alias("kind"),
            csv_quote(c["name"]).alias("csv_name"),
            F.concat(F.lit("The "), c["name"], F.lit(" is ")).alias("phrase"),
            F.concat(json_string(c["name"]), F.lit(": ")).alias("key"),
            sql_type(c["arrow_type"]).alias("sql_type"),
        )

    return tables.withColumn("kv_floats", floats).withColumn(
        "columns", F.transform("columns", prepared)
    )


def display_cells(cells: Column, columns: Column) -> Column:
    """Kept cells in column order; integers of a column with gaps print as floats."""

    def shown(c: Column) -> Column:
        cell = F.get(cells, c["pos"])
        return F.when(c["kind"] == "int_nullable", float_text(cell.cast("double"))).otherwise(cell)

    return F.transform(columns, shown)


def shown_as_is(columns: Column) -> Column:
    """How many cells a row has if it is displayed as it is, with every cell and none as float; else NULL."""
    moved = F.exists(F.transform(columns, lambda c, i: (c["pos"] != i) | (c["kind"] == "int_nullable")), lambda x: x)
    return F.when(~moved, F.size(columns))


# --- CSV -------------------------------------------------------------------


def time_mode(times: Column) -> Column:
    """The common precision of the present timestamps of one column."""
    present = F.filter(times, lambda t: t.isNotNull())
    return let(
        present,
        lambda some: F.when(F.forall(some, lambda t: t.endswith(" 00:00:00")), DATE)
        .when(F.exists(some, lambda t: t.contains(".") & ~t.endswith("000")), MICRO)
        .when(F.exists(some, lambda t: t.contains(".")), MILLI)
        .otherwise(PLAIN),
    )


def time_in_mode(text: Column, mode: Column) -> Column:
    return (
        F.when(mode == DATE, F.left(text, F.lit(10)))
        .when((mode == MICRO) & ~text.contains("."), F.concat(text, F.lit(".000000")))
        .when((mode == MILLI) & text.contains("."), F.left(text, F.lit(23)))
        .when(mode == MILLI, F.concat(text, F.lit(".000")))
        .otherwise(text)
    )


def csv_line(cells: Column, modes: Column) -> Column:
    """Comma-joined cells; a lone empty field prints as a pair of quotes."""

    def field(cell: Column, i: Column) -> Column:
        return let(
            F.get(modes, i),
            lambda mode: F.when(mode.isNull(), csv_quote(cell)).otherwise(
                time_in_mode(cell, mode)
            ),
        )

    line = F.array_join(F.transform(cells, field), ",", "")
    return F.when(
        F.size(cells) == 1, let(line, lambda t: F.when(t == "", '""').otherwise(t))
    ).otherwise(line)


def csv_row(cells: Column, columns: Column) -> Column:
    """One row as a slice of its own."""

    def mode(c: Column, i: Column) -> Column:
        return F.when(c["kind"] == "time", time_mode(F.array(F.get(cells, i))))

    return let(F.transform(columns, mode), lambda modes: csv_line(cells, modes))


def csv_lines(rows: Column, columns: Column) -> Column:
    def mode(c: Column, i: Column) -> Column:
        return F.when(c["kind"] == "time", time_mode(F.transform(rows, lambda r: F.get(r, i))))

    return let(
        F.transform(columns, mode),
        lambda modes: F.transform(rows, lambda r: csv_line(r, modes)),
        "array<string>",
    )


def csv_header(columns: Column) -> Column:
    return F.array_join(F.transform(columns, lambda c: c["csv_name"]), ",")


def csv_table(rows: Column, columns: Column) -> Column:
    lines = F.concat(F.array(csv_header(columns)), csv_lines(rows, columns))
    return F.rtrim(F.array_join(lines, "\n"), F.lit("\n"))


# --- key-value -------------------------------------------------------------


def keyvalue_row(cells: Column, columns: Column, kv_floats: Column) -> Column:
    """`The a is 1. The b is x.`; blank cells are left out, a row without any is NULL."""
    all_single = F.forall(columns, lambda c: c["kind"] == "single")

    def phrase(c: Column, i: Column) -> Column:
        cell = F.get(cells, i)
        text = (
            F.when((c["kind"] == "int") & kv_floats, float_text(cell.cast("double")))
            .when(
                (c["kind"] == "single") & ~all_single,
                float_text(cell.cast("float").cast("double")),
            )
            .otherwise(cell)
        )
        return F.when(~is_blank(cell), F.concat(c["phrase"], text))

    phrases = F.array_compact(F.transform(columns, phrase))
    return let(
        phrases,
        lambda p: F.when(F.size(p) > 0, F.concat(F.array_join(p, ". "), F.lit("."))),
    )


def keyvalue_table(rows: Column, columns: Column, kv_floats: Column) -> Column:
    return F.array_join(F.transform(rows, lambda r: keyvalue_row(r, columns, kv_floats)), "\n")


# --- JSON ------------------------------------------------------------------


def json_value(cell: Column, kind: Column, null_literal: str = "NaN") -> Column:
    missing = (
        F.when(kind.isin(NUMERIC), null_literal).when(kind == "time", '"NaT"').otherwise("null")
    )
    number = F.when(cell.endswith("inf"), F.replace(cell, F.lit("inf"), F.lit("Infinity")))
    return (
        F.when(cell.isNull(), missing)
        .when(kind == "object", json_string(cell))
        .when(kind == "int", cell)
        .when(kind.isin("float", "int_nullable"), F.coalesce(number, cell))
        .when(kind == "time", F.concat(F.lit('"'), cell, F.lit('"')))
        .when(kind == "single", F.coalesce(number, float_text(cell.cast("float").cast("double"))))
        .otherwise(F.lower(cell))
    )


def json_row(cells: Column, columns: Column) -> Column:
    members = F.transform(
        columns, lambda c, i: F.concat(c["key"], json_value(F.get(cells, i), c["kind"]))
    )
    return F.concat(F.lit("{"), F.array_join(members, ", "), F.lit("}"))


def json_table(rows: Column, columns: Column) -> Column:
    objects = F.array_join(F.transform(rows, lambda r: json_row(r, columns)), ", ")
    return F.concat(F.lit("["), objects, F.lit("]"))


# --- Markdown --------------------------------------------------------------
#
# A column prints by the most general type of its cells in the slice: whole numbers as they are, numbers with
# six significant digits, anything else as stripped text. Text that reads as a number counts as one. Numbers
# align at their decimal points. A cell with line breaks takes as many lines as it has.

BOOLS, WHOLES, NUMBERS, TEXTS = 1, 2, 3, 4
_DIGITS = "[0-9]+(_[0-9]+)*"
#: Text that reads as a whole number, or as any number, with blanks around it.
WHOLE_TEXT = f"^[-+]?{_DIGITS}$"
NUMBER_TEXT = rf"^([-+]?({_DIGITS}\.?({_DIGITS})?|\.{_DIGITS})([eE][-+]?{_DIGITS})?|-?[iI][nN][fF]|[nN][aA][nN])$"
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def _stripped(text: Column) -> Column:
    plain = F.substring(text, 1, 1).between("!", "~") & F.substring(text, -1, 1).between("!", "~")
    return F.when(plain, text).otherwise(F.btrim(text, F.lit(SPACES)))


def _number(text: Column) -> Column:
    return F.translate(_stripped(text), "_", "").try_cast("double")


def _cell_type(cell: Column, arrow_type: Column) -> Column:
    """Type of a cell of a column of objects; too large a number is text."""
    # What doesn't start like a number needs no pattern.
    start = F.substring(cell, 1, 1)
    typed = let(
        _stripped(cell),
        lambda t: F.when(t.rlike(WHOLE_TEXT) & ~arrow_type.startswith("decimal"), WHOLES)
        .when(t.rlike("[0-9]") & t.rlike(NUMBER_TEXT) & (F.abs(_number(t)) < float("inf")), NUMBERS)
        .when(F.lower(cell).isin("inf", "-inf", "nan"), NUMBERS)
        .otherwise(TEXTS),
        "int",
    )
    return (
        F.when(cell.isNull() | cell.isin("True", "False"), BOOLS)
        .when(start.between("A", "Z") & ~start.isin("I", "N"), TEXTS)
        .when(start.between("a", "z") & ~start.isin("i", "n"), TEXTS)
        .otherwise(typed)
    )


def markdown_types(rows: Column, columns: Column) -> Column:
    """Per column the type it prints by; whole numbers beside floats only are floats."""
    floats = F.forall(columns, lambda c: c["kind"].isin(NUMERIC)) & F.exists(
        columns, lambda c: c["kind"].isin(FLOATING)
    )

    def of_cells(c: Column, i: Column) -> Column:
        """Folds over the rows; after a text no cell is looked at."""
        return F.aggregate(
            rows,
            F.lit(BOOLS),
            lambda t, r: F.when(t == TEXTS, t).otherwise(F.greatest(t, _cell_type(F.get(r, i), c["arrow_type"]))),
        )

    return let(
        floats,
        lambda all_floats: F.transform(
            columns,
            lambda c, i: F.when(c["kind"].isin(FLOATING) | ((c["kind"] == "int") & all_floats), NUMBERS)
            .when(c["kind"] == "int", WHOLES)
            .when(c["kind"] == "object", of_cells(c, i))
            .otherwise(TEXTS),
        ),
        "array<int>",
    )


def markdown_cell(cell: Column, kind: Column, kind_printed: Column) -> Column:
    """A cell as it prints in a column of type `kind_printed`, before it is aligned."""
    missing = F.when(kind.isin(NUMERIC), "nan").when(kind == "time", "NaT").otherwise("")
    # The text of a float with at most six digits only loses its zeros.
    short = kind.isin(FLOATING) & (F.length(cell) <= 7) & cell.contains(".") & ~cell.contains("e")
    number = (
        F.when(short, F.rtrim(F.rtrim(cell, F.lit("0")), F.lit(".")))
        .when(cell.isin("True", "False"), cell)
        .otherwise(F.coalesce(six_digits(_number(cell)), F.lit("nan")))
    )
    return (
        F.when(cell.isNull(), missing)
        .when(kind_printed == NUMBERS, number)
        .when(kind_printed == TEXTS, _stripped(cell))
        .otherwise(cell)
    )


def _decimals(text: Column) -> Column:
    """Characters after the point, or after the exponent sign of a number without one; else -1."""
    point = F.when(text.contains("."), F.instr(text, ".")).when(text.contains("e"), F.instr(text, "e"))
    return F.when(text.rlike("^[-+]?[0-9]"), F.coalesce(F.length(text) - point, F.lit(-1))).otherwise(-1)


def _is_number(kind_printed: Column) -> Column:
    return kind_printed.isin(WHOLES, NUMBERS)


def _printed(rows: Column, columns: Column, types: Column) -> Column:
    """Rows of cells as they print, points aligned in columns of numbers."""

    def plain(r: Column) -> Column:
        return F.transform(columns, lambda c, i: markdown_cell(F.get(r, i), c["kind"], F.get(types, i)))

    def aligned(texts: Column) -> Column:
        def most(t: Column, i: Column) -> Column:
            return F.when(t == NUMBERS, F.array_max(F.transform(texts, lambda r: _decimals(F.get(r, i)))))

        def cell(text: Column, deepest: Column) -> Column:
            return F.when(deepest.isNull(), text).otherwise(
                F.concat(text, F.repeat(F.lit(" "), deepest - _decimals(text)))
            )

        return let(
            F.transform(types, most),
            lambda deepest: F.transform(texts, lambda r: F.transform(r, lambda x, i: cell(x, F.get(deepest, i)))),
            "array<array<string>>",
        )

    return let(
        F.transform(rows, plain),
        lambda texts: F.when(F.exists(types, lambda t: t == NUMBERS), aligned(texts)).otherwise(texts),
        "array<array<string>>",
    )


def _has_break(text: Column) -> Column:
    return F.coalesce(text.contains("\n") | text.contains("\r"), F.lit(False))


def _width(text: Column) -> Column:
    """The longest line of a text."""
    lines = F.split(text, "[\r\n]", -1)
    return F.when(_has_break(text), F.array_max(F.transform(lines, F.length))).otherwise(F.length(text))


def markdown_widths(printed: Column, columns: Column) -> Column:
    """Per column: the longest cell, or the name and two more."""

    def width(c: Column, i: Column) -> Column:
        lengths = F.transform(printed, lambda r: _width(F.get(r, i)))
        return F.greatest(_width(c["name"]) + 2, F.coalesce(F.array_max(lengths), F.lit(0)))

    return F.transform(columns, width)


def _pad(text: Column, kind_printed: Column, width: Column) -> Column:
    return F.when(_is_number(kind_printed), F.lpad(text, width, F.lit(" "))).otherwise(
        F.rpad(text, width, F.lit(" "))
    )


def _joined(cells: Column, types: Column, widths: Column) -> Column:
    padded = F.transform(cells, lambda text, i: _pad(F.coalesce(text, F.lit("")), F.get(types, i), F.get(widths, i)))
    return F.concat(F.lit("| "), F.array_join(padded, " | "), F.lit(" |"))


def _stacked(cells: Column, types: Column, widths: Column, breaks: str) -> Column:
    """Cells of several lines beside each other; shorter ones are filled with blanks below."""

    def pieces(text: Column) -> Column:
        return let(
            F.split(text, breaks, -1),
            lambda p: F.when((F.size(p) > 1) & (F.element_at(p, -1) == ""), F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p),
            "array<string>",
        )

    def lines(parts: Column) -> Column:
        most = F.array_max(F.transform(parts, F.size))
        return F.array_join(
            F.transform(
                F.sequence(F.lit(0), most - 1),
                lambda k: _joined(F.transform(parts, lambda p: F.get(p, k)), types, widths),
            ),
            "\n",
        )

    return let(F.transform(cells, pieces), lines)


def markdown_line(cells: Column, types: Column, widths: Column, stacked: Column) -> Column:
    return F.when(stacked, _stacked(cells, types, widths, LINE_BREAK)).otherwise(_joined(cells, types, widths))


def markdown_header(columns: Column, types: Column, widths: Column) -> Column:
    names = F.transform(columns, lambda c: c["name"])
    top = F.when(F.exists(names, _has_break), _stacked(names, types, widths, "[\r\n]")).otherwise(
        _joined(names, types, widths)
    )
    rules = F.transform(
        types,
        lambda t, i: let(
            F.repeat(F.lit("-"), F.get(widths, i) + 1),
            lambda dashes: F.when(_is_number(t), F.concat(dashes, F.lit(":"))).otherwise(F.concat(F.lit(":"), dashes)),
        ),
    )
    return F.concat(top, F.lit("\n|"), F.array_join(rules, "|"), F.lit("|"))


def _markdown(rows: Column, columns: Column, body: Callable[[Column, Column, Column, Column], Column]) -> Column:
    """`body` of the cells as printed, types, widths, and whether any cell or name has line breaks."""

    def laid_out(types: Column) -> Column:
        def measured(printed: Column) -> Column:
            stacked = F.exists(columns, lambda c: _has_break(c["name"])) | F.exists(rows, lambda r: F.exists(r, _has_break))
            return let(
                F.struct(markdown_widths(printed, columns).alias("widths"), stacked.alias("stacked")),
                lambda m: body(printed, types, m["widths"], m["stacked"]),
            )

        return let(_printed(rows, columns, types), measured)

    return let(markdown_types(rows, columns), laid_out)


def markdown_row(cells: Column, columns: Column) -> Column:
    """One row's lines as a slice of its own."""
    return _markdown(
        F.array(cells), columns, lambda printed, types, widths, stacked: markdown_line(F.get(printed, 0), types, widths, stacked)
    )


def markdown_top(first_row: Column, columns: Column) -> Column:
    """The header of a slice of one row."""
    return _markdown(
        F.array(first_row), columns, lambda printed, types, widths, stacked: markdown_header(columns, types, widths)
    )


def markdown_table(rows: Column, columns: Column) -> Column:
    def whole(printed: Column, types: Column, widths: Column, stacked: Column) -> Column:
        lines = F.transform(printed, lambda r: markdown_line(r, types, widths, stacked))
        return F.array_join(F.concat(F.array(markdown_header(columns, types, widths)), lines), "\n")

    return _markdown(rows, columns, whole)


# --- SQL schema ------------------------------------------------------------


def range_text(c: Column, present: Column) -> Column:
    """` -- range: a to b` of the present values of a column, nothing if there are none."""
    numbers = F.transform(present, lambda v: v.cast("double"))
    integers = F.transform(present, lambda v: v.cast("decimal(38,0)"))
    text = F.when(
        c["sql_type"] == "FLOAT",
        F.concat(
            F.lit(" -- range: "),
            three_digits(F.array_min(numbers)),
            F.lit(" to "),
            three_digits(F.array_max(numbers)),
        ),
    ).when(
        c["sql_type"] == "INT",
        F.concat(
            F.lit(" -- range: "),
            F.array_min(integers).cast("string"),
            F.lit(" to "),
            F.array_max(integers).cast("string"),
        ),
    )
    return F.when(F.size(present) > 0, F.coalesce(text, F.lit(""))).otherwise("")


def column_ranges(rows: DataFrame, tables: DataFrame, width: int | None = None) -> DataFrame:
    """Ranges over whole tables, of any size: minima and maxima combine on the map side.

    Copies of rows don't matter here. If all tables have the same `width`, a table's minima and
    maxima travel as one row.
    """
    if width is not None:
        return _row_ranges(rows, tables, width)
    columns = prepare_columns(tables).select("table_id", F.posexplode("columns").alias("i", "c"))
    numeric = columns.filter("c.sql_type <> 'VARCHAR'")
    cells = rows.select("table_id", F.posexplode("cells").alias("pos", "cell"))
    value = F.col("cell").try_cast("double")
    whole = F.col("cell").try_cast("decimal(38,0)")
    found = cells.groupBy("table_id", "pos").agg(
        F.min(value).alias("low"), F.max(value).alias("high"), F.min(whole).alias("ilow"), F.max(whole).alias("ihigh")
    )
    bounds = F.when(
        F.col("c.sql_type") == "FLOAT",
        F.concat(three_digits(F.col("low")), F.lit(" to "), three_digits(F.col("high"))),
    ).otherwise(F.concat(F.col("ilow").cast("string"), F.lit(" to "), F.col("ihigh").cast("string")))
    return numeric.withColumn("pos", F.col("c.pos")).join(found, ["table_id", "pos"]).select(
        "table_id",
        F.col("i").alias("pos"),
        F.col("c.name").alias("name"),
        F.col("c.sql_type").alias("sql_type"),
        F.concat(F.lit(" -- range: "), bounds).alias("bounds"),
    )


def _row_ranges(rows: DataFrame, tables: DataFrame, width: int) -> DataFrame:
    """`column_ranges` of tables of one width, with numbers of numeric columns only."""
    kinds = tables.select(F.explode("columns").alias("c")).select("c.pos", sql_type(F.col("c.arrow_type")).alias("t"))
    # One row per position and type.
    numeric = sorted((r.pos, r.t) for r in kinds.filter("t <> 'VARCHAR'").distinct().collect() if r.pos < width)
    if not numeric:
        empty = "table_id string, pos int, name string, sql_type string, bounds string"
        return rows.sparkSession.createDataFrame([], empty)

    def value(pos: int, kind: str) -> Column:
        return F.get("cells", F.lit(pos)).try_cast("double" if kind == "FLOAT" else "bigint")

    def text(low: Column, high: Column, kind: str) -> Column:
        shown = three_digits if kind == "FLOAT" else lambda v: v.cast("string")
        return F.concat(F.lit(" -- range: "), shown(low), F.lit(" to "), shown(high))

    ends = [f(value(*n)).alias(f"{name}{i}") for i, n in enumerate(numeric) for f, name in ((F.min, "low"), (F.max, "high"))]
    found = rows.groupBy("table_id").agg(*ends)
    bounds = F.array(
        *[
            F.struct(F.lit(pos).alias("at"), F.lit(kind).alias("sql_type"), text(F.col(f"low{i}"), F.col(f"high{i}"), kind).alias("bounds"))
            for i, (pos, kind) in enumerate(numeric)
        ]
    )
    names = F.transform("columns", lambda c, i: F.struct(i.alias("pos"), c["pos"].alias("at"), c["name"].alias("name"), sql_type(c["arrow_type"]).alias("sql_type")))
    kept = tables.select("table_id", F.filter(names, lambda c: c["sql_type"] != "VARCHAR").alias("names"))
    met = kept.join(found.select("table_id", bounds.alias("ranges")), "table_id")
    each = met.select("table_id", "ranges", F.inline("names"))
    mine = F.filter("ranges", lambda r: (r["at"] == F.col("at")) & (r["sql_type"] == F.col("sql_type")))
    return each.select("table_id", "pos", "name", "sql_type", F.get(mine, F.lit(0))["bounds"].alias("bounds"))


def sql_header(rows: Column | None, columns: Column) -> Column:
    """`CREATE TABLE` block; without rows there are no ranges."""

    def definition(c: Column, i: Column) -> Column:
        line = F.concat(F.lit('    "'), c["name"], F.lit('" '), c["sql_type"])
        if rows is None:
            return line
        present = F.filter(
            F.transform(rows, lambda r: F.get(r, i)), lambda v: v.isNotNull()
        )
        return F.concat(
            line,
            F.when(c["sql_type"] == "VARCHAR", "").otherwise(let(present, lambda p: range_text(c, p))),
        )

    return F.concat(
        F.lit("CREATE TABLE data (\n"),
        F.array_join(F.transform(columns, definition), ",\n"),
        F.lit("\n);\n"),
    )


def sql_schema_table(rows: Column, columns: Column) -> Column:
    lines = F.concat(F.array(csv_header(columns)), csv_lines(rows, columns))
    return F.concat(sql_header(rows, columns), F.array_join(lines, "\n"), F.lit("\n"))


# --- all formats -----------------------------------------------------------


def render_slice(fmt: Column, rows: Column, columns: Column, kv_floats: Column) -> Column:
    """Text of a slice in the format named by `fmt`."""
    return (
        F.when(fmt == "csv", csv_table(rows, columns))
        .when(fmt == "json", json_table(rows, columns))
        .when(fmt == "keyvalue", keyvalue_table(rows, columns, kv_floats))
        .when(fmt == "markdown", markdown_table(rows, columns))
        .when(fmt == "sql_schema", sql_schema_table(rows, columns))
    )


def row_texts(cells: Column, columns: Column, kv_floats: Column) -> dict[str, Column]:
    """One row's own text in each format, without header."""
    line = csv_row(cells, columns)
    return {
        "csv": line,
        "json": F.concat(F.lit("["), json_row(cells, columns), F.lit("]")),
        "keyvalue": F.coalesce(keyvalue_row(cells, columns, kv_floats), F.lit("")),
        "markdown": markdown_row(cells, columns),
        "sql_schema": line,
    }


def header_texts(first_row: Column, columns: Column) -> dict[str, Column]:
    """What every segment of a table repeats, as it is counted when packing."""
    csv = F.concat(csv_header(columns), F.lit("\n"))
    return {
        "csv": csv,
        "json": F.lit("[]"),
        "keyvalue": F.lit(""),
        "markdown": F.concat(markdown_top(first_row, columns), F.lit("\n")),
        "sql_schema": F.concat(sql_header(None, columns), csv, csv),
    }
