"""Token costs of rows and headers, as arrays in the order of `FORMATS`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablemill.constants import FORMATS
from tablemill.functions.text import built_once
from tablemill.functions.tokens import Tokenizer, count_words
from tablemill.operators.render import NUMERIC, csv_header, header_texts, markdown_top, row_texts, sql_header

# Stands between the cells of a row; a row that holds it itself isn't plain.
BORDER = "\x01"
# Stands for a missing cell.
MISSING = "\x02"
# ` -- range: a to b`
RANGE_WORDS = 5


@built_once
def _row_texts() -> dict[str, Column]:
    return row_texts(F.col("cells"), F.col("columns"), F.col("kv_floats"))


@built_once
def _header_texts() -> dict[str, Column]:
    return header_texts(F.col("cells"), F.col("columns"))


def _sum_of(columns: Column, part: str) -> Column:
    return F.aggregate(columns, F.lit(0), lambda n, c: n + count_words(c[part]))


def table_words(columns: Column) -> Column:
    """What a table's names add to the words of each of its rows and of its headers, and where its timestamps are."""
    times = F.array_compact(F.transform(columns, lambda c, i: F.when(c["kind"] == "time", i)))
    names = F.transform(columns, lambda c: c["name"])
    # The top of a Markdown table has the same words above any row; its rule is one.
    blank = F.transform(columns, lambda _: F.lit(None).cast("string"))
    broken = F.exists(names, lambda n: n.contains("\n") | n.contains("\r"))
    top = F.when(broken, count_words(markdown_top(blank, columns))).otherwise(
        count_words(F.concat(F.lit("| "), F.array_join(names, " | "), F.lit(" |"))) + 1
    )
    csv = count_words(csv_header(columns))
    return F.struct(
        F.size(columns).alias("n"),
        _sum_of(columns, "key").alias("keys"),
        _sum_of(columns, "phrase").alias("phrases"),
        times.alias("times"),
        # Words of a missing cell's phrase with its cell, and of its cell in Markdown beyond the one that prints.
        F.transform(columns, lambda c: count_words(c["phrase"]) + 1).alias("left_out"),
        F.transform(columns, lambda c: F.when(c["kind"].isin(*NUMERIC, "time"), 0).otherwise(1)).alias("blank"),
        F.array(csv, F.lit(1), F.lit(0), top, count_words(sql_header(None, columns)) + 2 * csv).alias("heads"),
        # Words of the ranges of an SQL schema, once every column has a value.
        F.aggregate(columns, F.lit(0), lambda n, c: n + F.when(c["sql_type"] == "VARCHAR", 0).otherwise(RANGE_WORDS)).alias("ranges"),
    )


def _plain_words(df: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """Words of plain rows by format, from the cells alone; `__plain` tells which rows are.

    In a plain row every cell that is there is printable ASCII with single spaces inside. What formats
    put around or into such a cell (quotes, escapes) sticks to its words, and what stands between cells is words of its own
    (names, bars) or sticks to the cells: words add up over cells. A missing cell prints as one word or none.
    `__adds` tells rows whose words also add up to those of any slice: no cell is missing, no time is midnight.
    """
    joined, spaces, n, missing = F.col("__joined"), F.col("__spaces"), F.col("words.n"), F.col("__missing")

    def count(char: str) -> Column:
        return F.length(joined) - F.length(F.replace(joined, F.lit(char), F.lit("")))

    plain = (F.length(joined) == F.octet_length(joined)) & (F.length(joined) > 0)
    for edge in (" ", BORDER):
        plain &= ~joined.startswith(edge) & ~joined.endswith(edge)
    for bad in (BORDER * 2, " " + BORDER, BORDER + " ", "  "):
        plain &= ~joined.contains(bad)
    plain &= ~joined.rlike("[\\x00\\x03-\\x1f\\x7f]") & (count(BORDER) == n - 1)
    plain &= ~joined.contains(MISSING) | (count(MISSING) == F.size(F.filter("cells", lambda c: c.isNull())))
    df = df.withColumn("__joined", F.array_join("cells", BORDER, MISSING))
    df = df.withColumns({"__plain": plain, "__spaces": count(" "), "__missing": joined.contains(MISSING)})
    # Dates of midnight print without a time in CSV.
    dates = F.when(F.size("words.times") == 0, 0).otherwise(
        F.aggregate("words.times", F.lit(0), lambda d, i: d + F.coalesce(F.get("cells", i).endswith(" 00:00:00").cast("int"), F.lit(0)))
    )
    df = df.withColumn("__dates", dates)

    def lost(part: str) -> Column:
        """What `part` says about the columns of missing cells, added up."""
        each = F.zip_with("cells", F.col(f"words.{part}"), lambda c, w: F.when(c.isNull(), w).otherwise(0))
        return F.when(missing, F.aggregate(each, F.lit(0), lambda a, w: a + w)).otherwise(0)

    df = df.withColumn("__adds", F.col("__plain") & ~missing & (F.col("__dates") == 0))
    return df, {
        "csv": 1 + spaces - F.col("__dates"),
        "json": F.col("words.keys") + n + spaces,
        "keyvalue": F.col("words.phrases") + n + spaces - lost("left_out"),
        "markdown": n + 1 + n + spaces - lost("blank"),
    }


def with_row_costs(df: DataFrame, tokenizer: Tokenizer, formats: list[str] | None = None) -> DataFrame:
    """Add `costs`; a JSON row counts at least 1 and excludes its brackets. Other formats than `formats` cost nothing.

    With `words` (from `table_words`), which goes, words of plain rows are added up; other rows, and
    all under other tokenizers, are rendered and counted. `heads` then has the table's header costs, `ranges` the
    words of its ranges, and `adds` tells rows whose costs add up in any slice.
    """
    texts = _row_texts()
    known = None
    if "words" in df.columns and tokenizer is count_words:
        df, known = _plain_words(df)
        df = df.withColumns({"adds": F.col("__adds"), "heads": F.col("words.heads"), "ranges": F.col("words.ranges")})
        texts = {fmt: F.when(~F.col("__plain"), text) for fmt, text in texts.items()}
    brackets = tokenizer(F.lit("[]"))
    # A row is the same line in CSV and below an SQL schema. The texts are columns of their
    # own first, so a tokenizer may look at its input more than once.
    names = {fmt: f"__{fmt}" for fmt in ["csv", "json", "keyvalue", "markdown"]}
    asked = {fmt for fmt in names if formats is None or fmt in formats or (fmt == "csv" and "sql_schema" in formats)}
    rendered = df.withColumns({names[fmt]: texts[fmt] for fmt in names if fmt in asked})
    counts = {fmt: tokenizer(F.col(names[fmt])).cast("int") for fmt in names if fmt in asked}
    if known is not None:
        counts = {fmt: F.when(F.col("__plain"), known[fmt]).otherwise(n) for fmt, n in counts.items()}
    if "json" in asked:
        counts["json"] = F.greatest(F.lit(1), counts["json"] - brackets).cast("int")
    rendered = rendered.withColumns({names[fmt]: counts.get(fmt, F.lit(0)) for fmt in names})
    extra = ["words", "__joined", "__plain", "__spaces", "__missing", "__dates", "__adds"]
    return rendered.withColumn("costs", F.array(*names.values(), "__csv")).drop(*names.values(), *extra)


def with_header_costs(
    df: DataFrame, tokenizer: Tokenizer, name: str = "header_costs", where: Column | None = None
) -> DataFrame:
    """Add the header costs of a table whose first row is in `cells`.

    Only rows that satisfy `where` render and count a header.
    """
    texts = _header_texts()
    if where is not None:
        texts = {fmt: F.when(where, text) for fmt, text in texts.items()}
    names = {fmt: f"__h_{fmt}" for fmt in FORMATS}
    rendered = df.withColumns({names[fmt]: texts[fmt] for fmt in FORMATS})
    counts = F.array(*[tokenizer(F.col(names[fmt])).cast("int") for fmt in FORMATS])
    return rendered.withColumn(name, counts).drop(*names.values())
