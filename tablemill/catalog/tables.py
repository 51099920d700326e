"""Queries over corpora: sources, cleaning, order, rendering, tokens, packing, fitting."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablemill.catalog import sql as S
from tablemill.catalog.corpora import (
    DOCUMENT,
    EVENT,
    LINE,
    NATION,
    NUMBERS,
    TALK,
    Spec,
    corpus,
    prepared,
    source,
)
from tablemill.catalog.registry import query
from tablemill.constants import FORMATS, HELD_OUT_CHUNKS, SAMPLE_SEED, SAMPLE_TABLES
from tablemill.functions import text as X
from tablemill.functions.tokens import count_words, file_tokenizer
from tablemill.operators import checks, clean, fit, order, pack, render, shards
from tablemill.plans.serialize import serialize
from tablemill.sources.corpus import select_chunks, table_id, table_seed

BUDGET = 200
SMALL = 60


def with_(sql: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{sql}\n{select}"


# --- sources ------------------------------------------------------------------


@query(
    "corpus_from_tables",
    with_(S.base(NATION), "SELECT table_id, chunk, seed, tag AS row_tag, array_to_string(list_transform(cells, lambda c: coalesce(c, '?')), '|') AS cells FROM tagged"),
)
def corpus_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = corpus(spark, sf, NATION).rows
    return rows.select("table_id", "chunk", "seed", "row_tag", F.array_join("cells", "|", "?").alias("cells"))


@query("table_ids", with_(S.base(TALK), "SELECT DISTINCT chunk, member, table_id FROM base"))
def table_ids(spark, sf):
    return corpus(spark, sf, TALK).tables.select("chunk", "member", "table_id")


@query(
    "select_chunks",
    with_(S.base(LINE), "SELECT table_id, count(*) AS n_rows FROM base WHERE chunk IN (24, 25) GROUP BY table_id"),
)
def held_out(spark, sf):
    rows = select_chunks(corpus(spark, sf, LINE).rows, HELD_OUT_CHUNKS)
    return rows.groupBy("table_id").agg(F.sum("n_copies").alias("n_rows"))


# --- cleaning -----------------------------------------------------------------

REPORT = "SELECT table_id, pos, name, kind, n_rows, n_valid, longest, dropped FROM cols"


@query("drop_artifact_columns", with_(S.cells(DOCUMENT), "SELECT table_id, name FROM cols WHERE NOT (name LIKE 'Unnamed%' OR name = 'index')"))
def artifacts(spark, sf):
    tables = clean.drop_artifact_columns(corpus(spark, sf, DOCUMENT).tables)
    return tables.select("table_id", F.explode("columns").alias("c")).select("table_id", F.col("c.name").alias("name"))


@query("drop_all_null_columns", with_(S.cells(DOCUMENT), "SELECT table_id, name FROM cols WHERE n_valid > 0"))
def all_null(spark, sf):
    return clean.column_report(corpus(spark, sf, DOCUMENT)).filter("n_valid > 0").select("table_id", "name")


@query("drop_long_text_columns", with_(S.cells(TALK), "SELECT table_id, name, longest, dropped FROM cols WHERE kind = 'object'"))
def long_text(spark, sf):
    report = clean.column_report(corpus(spark, sf, TALK))
    return report.filter("kind = 'object'").select("table_id", "name", "longest", "dropped")


def _column_report(spec: Spec):
    def run(spark, sf):
        return clean.column_report(corpus(spark, sf, spec)).select(
            "table_id", "pos", "name", "kind", "n_rows", "n_valid", "longest", "dropped"
        )

    return run


query("clean_report", with_(S.cells(DOCUMENT), REPORT))(_column_report(DOCUMENT))
query("nullable_int_kind", with_(S.cells(NATION), REPORT))(_column_report(NATION))


@query(
    "clean_cells",
    with_(S.cells(TALK), "SELECT table_id, ord, string_agg(coalesce(cell, '?'), '|' ORDER BY i) AS cells FROM cell GROUP BY table_id, ord"),
)
def cleaned(spark, sf):
    p = prepared(spark, sf, TALK)
    ordered = order.shuffle_rows(p.corpus.rows, p.large, p.corpus.unique)
    rows = clean.clean_cells(ordered, p.tables, p.large)
    return rows.select("table_id", "ord", F.array_join("cells", "|", "?").alias("cells"))


@query("drop_empty_tables", with_(S.cells(TALK), "SELECT table_id, n_rows, n_cols FROM tabs"))
def nonempty(spark, sf):
    return clean.clean_tables(corpus(spark, sf, TALK)).select(
        "table_id", "n_rows", F.size("columns").cast("bigint").alias("n_cols")
    )


@query(
    "is_valid_table",
    with_(
        S.costs(S.positioned(NUMBERS)),
        "SELECT table_id, any_value(n_rows) AS n_rows FROM headers JOIN tabs USING (table_id) "
        "GROUP BY table_id HAVING max(header) < 20 AND any_value(n_rows) >= 2",
    ),
)
def valid(spark, sf):
    p = prepared(spark, sf, NUMBERS)
    return clean.valid_tables(pack.table_headers(order.by_position(p.corpus), p.tables), 20).select("table_id", "n_rows")


# --- order --------------------------------------------------------------------


@query("table_seed", with_(S.base(LINE), "SELECT DISTINCT member, seed FROM base"))
def seeds(spark, sf):
    return corpus(spark, sf, LINE).tables.select("member", table_seed(F.col("member")).alias("seed"))


@query(
    "shuffle_rows",
    with_(S.base(LINE), "SELECT table_id, ord, array_to_string(cells, '|') AS cells FROM ordered"),
)
def shuffled(spark, sf):
    p = prepared(spark, sf, LINE)
    rows = order.shuffle_rows(p.corpus.rows, p.large, p.corpus.unique, p.corpus.plain)
    return rows.select("table_id", "ord", F.array_join("cells", "|").alias("cells"))


@query(
    "shuffle_rows_texts",
    with_(S.base(DOCUMENT), "SELECT table_id, ord, sum(coalesce(length(c), 0))::BIGINT AS chars, max(length(c))::BIGINT AS longest "
          "FROM (SELECT table_id, ord, unnest(cells) AS c FROM ordered) GROUP BY table_id, ord"),
)
def shuffled_texts(spark, sf):
    p = prepared(spark, sf, DOCUMENT)
    rows = order.shuffle_rows(p.corpus.rows, p.large, p.corpus.unique)
    lengths = F.transform("cells", lambda c: F.coalesce(F.length(c), F.lit(0)).cast("bigint"))
    total = F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, b: a + b)
    return rows.select("table_id", "ord", total.alias("chars"), F.array_max(lengths).alias("longest"))


@query(
    "rows_by_position",
    with_(S.base(S.positioned(EVENT)), "SELECT table_id, ord, array_to_string(cells, '|') AS cells FROM ordered"),
)
def placed(spark, sf):
    own = order.by_position(prepared(spark, sf, EVENT).corpus)
    rows = order.shuffle_rows(own.rows, None, own.unique)
    return rows.select("table_id", "ord", F.array_join("cells", "|").alias("cells"))


@query("sorted_members", with_(S.base(NATION), "SELECT chunk, member, row_number() OVER (PARTITION BY chunk ORDER BY member) AS n FROM (SELECT DISTINCT chunk, member FROM base)"))
def members(spark, sf):
    return order.sorted_members(corpus(spark, sf, NATION).tables)


@query(
    "sample_tables",
    with_(S.cells(LINE), f"SELECT table_id FROM tabs ORDER BY md5('{SAMPLE_SEED}-' || table_id), table_id LIMIT {SAMPLE_TABLES}"),
)
def sampled(spark, sf):
    return order.sample_tables(prepared(spark, sf, LINE).tables, SAMPLE_TABLES, SAMPLE_SEED).select("table_id")


# --- numbers ------------------------------------------------------------------

FLOATS = {
    "big": "l_extendedprice * 1e12",
    "small": "l_extendedprice / 1e9",
    "tiny": "l_tax / 1e5",
    "ratio": "l_extendedprice / l_quantity",
    "signed": "l_discount - l_tax",
}


def _numbers(make):
    def run(spark, sf):
        df = source(spark, sf, "lineitem")
        return df.select("l_orderkey", "l_linenumber", *[make(F.expr(e)).alias(n) for n, e in FLOATS.items()])

    return run


query(
    "py_float",
    "SELECT l_orderkey, l_linenumber, " + ", ".join(f"({e})::VARCHAR AS {n}" for n, e in FLOATS.items()) + " FROM lineitem",
)(_numbers(X.float_text))
query(
    "fmt_3g",
    "SELECT l_orderkey, l_linenumber, " + ", ".join(f"format('{{:.3g}}', ({e})::DOUBLE) AS {n}" for n, e in FLOATS.items()) + " FROM lineitem",
)(_numbers(X.three_digits))


@query(
    "cell_text",
    f"SELECT event_id, {S.cell('ts', 'timestamp_ntz')} AS ts, {S.cell('value', 'double')} AS value, "
    f"{S.cell('value > 50', 'boolean')} AS flag, {S.cell('user_id', 'bigint')} AS user_id FROM events",
)
def cell_texts(spark, sf):
    df = source(spark, sf, "events").withColumn("flag", F.col("value") > 50)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.select("event_id", *[X.cell_text(F.col(c), kinds[c]).alias(c) for c in ["ts", "value", "flag", "user_id"]])


# --- rendering ----------------------------------------------------------------


def _rows(spark, sf, spec: Spec) -> DataFrame:
    p = prepared(spark, sf, spec)
    return pack.costed_rows(p.corpus, p.tables, p.large)


def _row_text(spec: Spec, name: str):
    def run(spark, sf):
        texts = render.row_texts(F.col("cells"), F.col("columns"), F.col("kv_floats"))
        out = texts[name]
        if name == "json":
            out = render.json_row(F.col("cells"), F.col("columns"))
        if name == "keyvalue":
            out = render.keyvalue_row(F.col("cells"), F.col("columns"), F.col("kv_floats"))
        return _rows(spark, sf, spec).select("table_id", "ord", out.alias("line"))

    return run


def _line_sql(spec: Spec, name: str) -> str:
    return with_(S.row_texts(spec), f"SELECT table_id, ord, {name} AS line FROM texts")


query("csv_row", _line_sql(EVENT, "csv"))(_row_text(EVENT, "csv"))
query("csv_row_gaps", _line_sql(NATION, "csv"))(_row_text(NATION, "csv"))
query("keyvalue_row", _line_sql(NATION, "keyvalue"))(_row_text(NATION, "keyvalue"))
query("keyvalue_row_numbers", _line_sql(NUMBERS, "keyvalue"))(_row_text(NUMBERS, "keyvalue"))
query("json_row", _line_sql(NATION, "json"))(_row_text(NATION, "json"))
query("json_row_escapes", _line_sql(TALK, "json"))(_row_text(TALK, "json"))
query("markdown_row", _line_sql(TALK, "markdown"))(_row_text(TALK, "markdown"))


@query("sql_type", with_(S.cells(LINE), "SELECT table_id, name, sql_type FROM kept"))
def sql_types(spark, sf):
    tables = prepared(spark, sf, LINE).tables.select("table_id", F.inline("columns"))
    return tables.select("table_id", "name", render.sql_type(F.col("arrow_type")).alias("sql_type"))


def _slice_sql(spec: Spec, budget: int, fmt: str | None = None) -> str:
    pick = f" WHERE format = '{fmt}'" if fmt else ""
    return with_(
        f"{S.packed(spec, budget)}, chosen AS (SELECT * FROM packed{pick}), {S.slices('chosen')}",
        "SELECT table_id, format, seg AS seg_no, start_ord, end_ord, text FROM slice_text",
        True,
    )


def _slices(spec: Spec, budget: int, fmt: str | None = None):
    def run(spark, sf):
        packed = pack.pack_segments(*prepared(spark, sf, spec), budget, formats=[fmt] if fmt else None)
        return pack.segment_text(packed).drop("n_rows")

    return run


query("csv_table", _slice_sql(EVENT, SMALL, "csv"))(_slices(EVENT, SMALL, "csv"))
query("markdown_table", _slice_sql(NATION, SMALL, "markdown"))(_slices(NATION, SMALL, "markdown"))
query("json_records", _slice_sql(TALK, BUDGET, "json"))(_slices(TALK, BUDGET, "json"))
query("sql_schema_table", _slice_sql(NATION, SMALL, "sql_schema"))(_slices(NATION, SMALL, "sql_schema"))
query("serialize_tables", _slice_sql(NATION, 100_000))(_slices(NATION, 100_000))
query("segment_text", _slice_sql(EVENT, BUDGET))(_slices(EVENT, BUDGET))


@query(
    "column_ranges",
    with_(
        S.cells(LINE),
        "SELECT table_id, i AS pos, name, sql_type, CASE WHEN sql_type = 'FLOAT' "
        "THEN ' -- range: ' || format('{:.3g}', min(cell::DOUBLE)) || ' to ' || format('{:.3g}', max(cell::DOUBLE)) "
        "ELSE ' -- range: ' || min(cell::BIGINT)::VARCHAR || ' to ' || max(cell::BIGINT)::VARCHAR END AS bounds "
        "FROM cell WHERE sql_type <> 'VARCHAR' GROUP BY table_id, i, name, sql_type",
    ),
)
def ranges_of_columns(spark, sf):
    p = prepared(spark, sf, LINE)
    narrow = p.corpus.plain is not None and p.corpus.width is not None and p.corpus.width <= clean.NARROW
    return render.column_ranges(*((p.corpus.plain, p.tables, p.corpus.width) if narrow else (p.corpus.rows, p.tables)))


@query(
    "sql_schema_fallback",
    with_(
        S.row_texts(NUMBERS),
        "SELECT table_id, ord + 1 AS line_no, csv AS line FROM texts UNION ALL "
        "SELECT table_id, 0, string_agg(name, ',' ORDER BY i) FROM kept GROUP BY table_id",
    ),
)
def fallback(spark, sf):
    return fit.schema_free_lines(_rows(spark, sf, NUMBERS))


# --- tokens -------------------------------------------------------------------


@query("count_tokens", f"SELECT doc_id, {S.tokens('text')} AS n_tokens FROM documents")
def counted(spark, sf):
    return source(spark, sf, "documents").select("doc_id", count_words(F.col("text")).alias("n_tokens"))


def _long_costs(rows: DataFrame, array: str, name: str) -> DataFrame:
    entries = F.arrays_zip(F.array(*[F.lit(f) for f in FORMATS]).alias("format"), F.col(array).alias("cost"))
    keep = [c for c in ["table_id", "ord"] if c in rows.columns]
    return rows.select(*keep, F.inline(entries)).withColumnRenamed("cost", name)


def _row_costs(spec: Spec):
    return lambda spark, sf: _long_costs(_rows(spark, sf, spec), "costs", "cost")


def _row_cost_sql(spec: Spec) -> str:
    return with_(S.costs(spec), "SELECT table_id, ord, format, cost FROM costs")


query("row_costs", _row_cost_sql(TALK))(_row_costs(TALK))
query("row_costs_lineitem", _row_cost_sql(LINE))(_row_costs(LINE))


@query("header_costs", with_(S.costs(NATION), "SELECT table_id, format, header FROM headers"))
def headers(spark, sf):
    p = prepared(spark, sf, NATION)
    return _long_costs(pack.table_headers(p.corpus, p.tables), "header_costs", "header")


@query(
    "segment_tokens",
    with_(
        f"{S.packed(NATION, BUDGET)}, {S.slices('packed')}",
        f"SELECT table_id, format, seg AS seg_no, {S.tokens('text')} AS n_tokens FROM slice_text",
        True,
    ),
)
def seg_tokens(spark, sf):
    return serialize(prepared(spark, sf, NATION), BUDGET).select("table_id", "format", "seg_no", "n_tokens")


# --- packing ------------------------------------------------------------------


def _ranges(spec: Spec, budget: int):
    def run(spark, sf):
        found = pack.pack_ranges(*prepared(spark, sf, spec), budget)
        return found.filter("seg_no is not null")

    return run


def _range_sql(spec: Spec, budget: int) -> str:
    return with_(
        S.packed(spec, budget),
        "SELECT table_id, format, seg AS seg_no, min(ord) AS start_ord, max(ord) + 1 AS end_ord FROM packed "
        "WHERE seg IS NOT NULL GROUP BY table_id, format, seg",
        True,
    )


query("pack_segments", _range_sql(LINE, BUDGET))(_ranges(LINE, BUDGET))
query("pack_segments_tight", _range_sql(TALK, BUDGET))(_ranges(TALK, BUDGET))


@query(
    "pack_segments_split",
    _range_sql(EVENT, SMALL),
)
def split_packing(spark, sf):
    """The same packing with every table of more than 20 rows cut into splits."""
    p = prepared(spark, sf, EVENT)
    cut = p.tables.filter("n_rows > 20").select("table_id", F.ceil(F.col("n_rows") / 20).cast("int").alias("n_splits"))
    return pack.pack_ranges(p.corpus, p.tables, cut, SMALL).filter("seg_no is not null")


# Rows of conversations above it stand first, in the middle, last and in sequence.
TIGHT = 45


@query(
    "oversize_rows",
    with_(S.costs(TALK), f"SELECT table_id, format, ord FROM costs WHERE cost > {TIGHT} - header"),
)
def oversize(spark, sf):
    found = pack.pack_ranges(*prepared(spark, sf, TALK), TIGHT).filter("seg_no is null")
    return found.select("table_id", "format", F.col("start_ord").alias("ord"))


@query(
    "rows_kept",
    with_(
        S.packed(TALK, TIGHT),
        "SELECT format, count(seg) AS rows_written, count(*) - count(seg) AS rows_dropped, "
        "count(DISTINCT (table_id, seg)) FILTER (seg IS NOT NULL) AS segments FROM packed GROUP BY format",
        True,
    ),
)
def kept(spark, sf):
    return pack.rows_kept(pack.pack_ranges(*prepared(spark, sf, TALK), TIGHT))


# --- fitting ------------------------------------------------------------------


def fit_sql(spec: Spec, budget: int) -> str:
    """Longest prefix by running sums; the ranges of an SQL schema count from the first value on."""
    return f"""{S.costs(spec)},
seen AS (SELECT table_id, i, min(ord) FILTER (cell IS NOT NULL) AS first_ord FROM cell
         WHERE sql_type <> 'VARCHAR' GROUP BY table_id, i),
extra AS (SELECT c.table_id, c.ord, count(s.i) * 5 AS n FROM (SELECT DISTINCT table_id, ord FROM costs) c
          LEFT JOIN seen s ON s.table_id = c.table_id AND s.first_ord <= c.ord GROUP BY c.table_id, c.ord),
names AS (SELECT table_id, {S.tokens('h_csv')} AS n FROM heads),
sums AS (SELECT c.table_id, c.format, c.ord, sum(c.cost) OVER (PARTITION BY c.table_id, c.format ORDER BY c.ord)
           + CASE c.format WHEN 'sql_schema' THEN c.header - n.n + e.n WHEN 'json' THEN c.ord + 1 ELSE c.header END AS total
         FROM costs c JOIN names n USING (table_id) JOIN extra e USING (table_id, ord)),
fits AS (SELECT table_id, format, coalesce(max(ord + 1) FILTER (total <= {budget}), 0) AS fit_n FROM sums GROUP BY table_id, format)"""


def _fit(spark, sf, spec, budget):
    return fit.fit_rows(*prepared(spark, sf, spec), budget)


@query(
    "fit_rows",
    with_(fit_sql(S.positioned(NUMBERS), SMALL), "SELECT table_id, format, fit_n FROM fits"),
)
def fitted(spark, sf):
    return _fit(spark, sf, NUMBERS, SMALL).select("table_id", "format", "fit_n")


FIT_TEXT = with_(
    f"{fit_sql(S.positioned(EVENT), BUDGET)}, chosen AS (SELECT c.table_id, c.format, c.ord, 0 AS seg FROM costs c JOIN fits f "
    f"USING (table_id, format) WHERE c.ord < f.fit_n), {S.slices('chosen')}",
    "SELECT f.table_id, f.format, f.fit_n, s.text FROM fits f LEFT JOIN slice_text s USING (table_id, format)",
)


@query("serialize_all_formats", FIT_TEXT)
def all_formats(spark, sf):
    return _fit(spark, sf, EVENT, BUDGET).select("table_id", "format", "fit_n", "text")


@query(
    "truncate_to_budget",
    with_(
        fit_sql(S.positioned(NUMBERS), SMALL),
        "SELECT table_id, format, CASE WHEN format = 'sql_schema' THEN n_rows ELSE greatest(1, fit_n) END AS n_kept "
        "FROM fits JOIN tabs USING (table_id)",
    ),
)
def truncated(spark, sf):
    return fit.truncated_rows(_fit(spark, sf, NUMBERS, SMALL))


@query(
    "missing_formats",
    with_(
        fit_sql(S.positioned(NUMBERS), 18),
        "SELECT table_id, string_agg(format, ',' ORDER BY format) AS missing FROM fits WHERE fit_n = 0 GROUP BY table_id",
    ),
)
def missing(spark, sf):
    return fit.missing_formats(_fit(spark, sf, NUMBERS, 18))


# --- shards and splits ----------------------------------------------------------


@query(
    "train_valid_split",
    with_(S.cells(LINE), f"SELECT table_id, CASE WHEN {S.bucket('table_id', 1000)} < 983 THEN 'train' ELSE 'valid' END AS part FROM tabs"),
)
def split(spark, sf):
    return shards.train_valid_split(prepared(spark, sf, LINE).tables).select("table_id", "part")


TOKENIZE = f"""{S.packed(NATION, BUDGET)}, {S.slices('packed')},
w AS (SELECT format, table_id, seg, unnest(regexp_extract_all(translate(text, '{S.WIDE_SPACES}', '{" " * len(S.WIDE_SPACES)}'), '{S.WORD}')) AS token,
             generate_subscripts(regexp_extract_all(translate(text, '{S.WIDE_SPACES}', '{" " * len(S.WIDE_SPACES)}'), '{S.WORD}'), 1) AS idx FROM slice_text),
v AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, encode(token)) - 1 AS token_id FROM w GROUP BY token)"""


@query(
    "tokenize_segments",
    with_(
        TOKENIZE,
        f"SELECT format, {S.bucket('table_id || chr(45) || seg::VARCHAR', 28)} AS shard, table_id, seg AS seg_no, "
        "string_agg(token_id::VARCHAR, ' ' ORDER BY idx) AS token_ids FROM w JOIN v USING (token) GROUP BY format, table_id, seg",
        True,
    ),
)
def tokenized(spark, sf):
    ids = shards.tokenize_segments(serialize(prepared(spark, sf, NATION), BUDGET))
    return ids.withColumn("token_ids", F.array_join(F.transform("token_ids", lambda t: t.cast("string")), " "))


def _tokenizer_file() -> str:
    """A public tokenizer; library functions take any path."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path("word_bpe_49k.json"))


@query("encode_segments")
def encoded(spark, sf):
    """Ids under a tokenizer file, which SQL can't give; tested against the tokenizer itself."""
    ids = shards.encode_segments(serialize(prepared(spark, sf, NATION), BUDGET), _tokenizer_file())
    return ids.withColumn("token_ids", F.array_join(F.transform("token_ids", lambda t: t.cast("string")), " "))


@query("fit_rows_tokenizer_file")
def fitted_by_file(spark, sf):
    """Longest prefixes under a tokenizer file; tested against encoding every prefix."""
    return fit.fit_rows(*prepared(spark, sf, NATION), BUDGET, file_tokenizer(_tokenizer_file())).select("table_id", "format", "fit_n", "n_rows")


@query(
    "split_by_position",
    "SELECT doc_id, n_chars AS n_tokens, first_token::BIGINT AS first_token, CASE WHEN first_token * 1000 < total * 983 THEN 'train' ELSE 'valid' END AS part "
    "FROM (SELECT doc_id, n_chars, coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_token, "
    "sum(n_chars) OVER () AS total FROM documents)",
)
def split_documents(spark, sf):
    docs = source(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("n_tokens"))
    return shards.split_by_position(docs, ["doc_id"])


SHARD_BYTES = f"shard AS (SELECT lang AS format, ({S.bucket('doc_id::VARCHAR', 28)}) AS shard, sum(n_chars) AS bytes FROM documents GROUP BY 1, 2)"


@query(
    "shard_select",
    with_(
        SHARD_BYTES,
        "SELECT f.format, s.shard, coalesce(bytes, 0) > 0 AS present, CASE WHEN bytes > 0 THEN 1.0 END::DOUBLE AS weight "
        "FROM (SELECT DISTINCT format FROM shard) f CROSS JOIN range(24) s(shard) LEFT JOIN shard b ON b.format = f.format AND b.shard = s.shard",
    ),
)
def selected_shards(spark, sf):
    docs = source(spark, sf, "documents")
    sizes = docs.groupBy(
        F.col("lang").alias("format"), shards.hash_bucket(F.col("doc_id").cast("string"), 28).alias("shard")
    ).agg(F.sum("n_chars").alias("bytes"))
    return shards.shard_select(sizes)


@query(
    "holdout_leak",
    "WITH t AS (SELECT (user_id % 26)::INT AS chunk, 'chunk' || lpad((user_id % 26)::VARCHAR, 4, '0') || '__u' || user_id AS table_id, "
    "list_sort(list(event_type)) AS content FROM events GROUP BY user_id), "
    "p AS (SELECT *, len(list_filter(content, lambda x: x = 'click')) > 12 AS k, len(content) % 7 AS m FROM t) "
    "SELECT DISTINCT table_id FROM p WHERE chunk IN (24, 25) AND EXISTS "
    "(SELECT 1 FROM p q WHERE q.chunk NOT IN (24, 25) AND q.k = p.k AND q.m = p.m)",
)
def leak(spark, sf):
    """Tables of one row that says how a user's events look; equal content is common."""
    events = source(spark, sf, "events")
    users = events.groupBy("user_id").agg(
        (F.count_if(F.col("event_type") == "click") > 12).alias("k"), (F.count(F.lit(1)) % 7).alias("m")
    )
    chunk = (F.col("user_id") % 26).cast("int")
    rows = users.select(
        chunk.alias("chunk"),
        table_id(chunk, F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("table_id"),
        F.lit(1).alias("n_copies"),
        F.array(F.col("k").cast("string"), F.col("m").cast("string")).alias("cells"),
    )
    return checks.holdout_leak(rows, HELD_OUT_CHUNKS).select("table_id")
