"""SQL for another engine that computes the same results from the same tables.

The building blocks are common table expressions over long rows: one row per cell.
"""

from __future__ import annotations

from tablemill.catalog.corpora import Spec
from tablemill.constants import MAX_CELL_CHARS, SPACES, WIDE_SPACES, WORD

ARROW = {
    "bigint": "int64",
    "int": "int32",
    "double": "double",
    "string": "string",
    "boolean": "bool",
    "timestamp_ntz": "timestamp[us]",
}
NUMERIC = "('int', 'int_nullable', 'float', 'single')"
FLOATING = "('int_nullable', 'float', 'single')"
ID = (
    "'chunk' || CASE WHEN {c} < 10000 THEN lpad(({c})::VARCHAR, 4, '0') ELSE ({c})::VARCHAR END "
    "|| '__' || replace({m}, '/', '__')"
)


def cell(expression: str, kind: str) -> str:
    if kind == "boolean":
        return f"CASE WHEN ({expression}) THEN 'True' WHEN NOT ({expression}) THEN 'False' END"
    if kind == "timestamp_ntz":
        return (
            f"CASE WHEN date_trunc('second', {expression}) = {expression} "
            f"THEN strftime({expression}, '%Y-%m-%d %H:%M:%S') "
            f"ELSE strftime({expression}, '%Y-%m-%d %H:%M:%S.%f') END"
        )
    return f"({expression})::VARCHAR"


def table_id(spec: Spec) -> str:
    return ID.format(c=f"({spec.chunk})", m=f"({spec.member})")


def seed(member: str) -> str:
    return f"('0x' || substr(md5(split_part({member}, '=', 1)), 1, 8))::BIGINT"


def tokens(text: str) -> str:
    spaces = " " * len(WIDE_SPACES)
    return f"len(regexp_extract_all(translate({text}, '{WIDE_SPACES}', '{spaces}'), '{WORD}'))"


def bucket(key: str, n: int) -> str:
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT % {n})"


def escape(text: str) -> str:
    unit = (
        "CASE ch WHEN '\"' THEN '\\\"' WHEN '\\' THEN '\\\\' WHEN chr(10) THEN '\\n' "
        "WHEN chr(13) THEN '\\r' WHEN chr(9) THEN '\\t' WHEN chr(8) THEN '\\b' WHEN chr(12) THEN '\\f' "
        "ELSE CASE WHEN unicode(ch) BETWEEN 32 AND 126 THEN ch "
        "WHEN unicode(ch) < 65536 THEN '\\u' || format('{:04x}', unicode(ch)) "
        "ELSE '\\u' || format('{:04x}', 55296 + (unicode(ch) - 65536) // 1024) "
        "|| '\\u' || format('{:04x}', 56320 + (unicode(ch) - 65536) % 1024) END END"
    )
    return (
        f"coalesce(list_aggregate(list_transform(regexp_extract_all({text}, '(?s).', 0), "
        f"lambda ch: {unit}), 'string_agg', ''), '')"
    )


def quote(text: str) -> str:
    return (
        f"CASE WHEN regexp_matches({text}, '[,\"\\r\\n]') "
        f"THEN '\"' || replace({text}, '\"', '\"\"') || '\"' ELSE {text} END"
    )


def positioned(spec: Spec) -> Spec:
    """The corpus with its rows in their own order."""
    return spec._replace(by_position=True)


def base(spec: Spec) -> str:
    cells = ", ".join(cell(e, t) for _, e, t in spec.columns)
    keys = "".join(f", {k}" for k in spec.row_key or [])
    if spec.row_key:
        tag = "concat_ws('-', " + ", ".join(f"{k}::VARCHAR" for k in spec.row_key) + ")"
        tagged = f"SELECT *, {tag} AS tag, 1 AS copy FROM base"
    else:
        digest = (
            "md5(array_to_string(list_transform(cells, lambda c: coalesce(c, chr(30))), chr(31)))"
        )
        tagged = (
            f"SELECT *, {digest} || '-' || ((copy - 1) // 10000)::VARCHAR AS tag FROM "
            "(SELECT *, row_number() OVER (PARTITION BY table_id, cells) AS copy FROM base)"
        )
    order = spec.row_key[0] if spec.by_position else "md5(seed::VARCHAR || '-' || tag)"
    return f"""base AS (
  SELECT ({spec.chunk})::INTEGER AS chunk, {spec.member} AS member, {table_id(spec)} AS table_id,
         {seed('(' + spec.member + ')')} AS seed, [{cells}] AS cells{keys} FROM {spec.source}),
tagged AS ({tagged}),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY table_id
                               ORDER BY {order}, copy) - 1 AS ord FROM tagged)"""


def cells(spec: Spec) -> str:
    """Up to `cell`: one row per kept cell, with its display text."""
    rows = ", ".join(f"({i}, '{n}', '{ARROW[t]}')" for i, (n, _, t) in enumerate(spec.columns))
    return f"""{base(spec)},
meta(pos, name, arrow_type) AS (VALUES {rows}),
long AS (SELECT table_id, chunk, member, ord, pos, cells[pos + 1] AS cell
         FROM ordered, range({len(spec.columns)}) t(pos)),
stats AS (SELECT table_id, pos, any_value(chunk) AS chunk, any_value(member) AS member, count(*) AS n_rows, count(cell) AS n_valid,
                 max(length(cell)) AS longest FROM long GROUP BY table_id, pos),
kinds AS (SELECT *, CASE WHEN arrow_type = 'double' THEN 'float'
                         WHEN arrow_type LIKE 'int%' AND n_valid < n_rows THEN 'int_nullable'
                         WHEN arrow_type LIKE 'int%' THEN 'int'
                         WHEN arrow_type = 'bool' AND n_valid = n_rows THEN 'bool'
                         WHEN arrow_type = 'bool' THEN 'bool_object'
                         WHEN arrow_type LIKE 'timestamp%' THEN 'time'
                         ELSE 'object' END AS kind
          FROM stats JOIN meta USING (pos)),
cols AS (SELECT *, CASE WHEN name LIKE 'Unnamed%' OR name = 'index' THEN 'artifact'
                        WHEN n_valid = 0 THEN 'all_null'
                        WHEN kind IN ('object', 'bool_object') AND longest > {MAX_CELL_CHARS} THEN 'long_text'
                   END AS dropped FROM kinds),
kept AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY pos) - 1 AS i,
                CASE WHEN kind = 'float' THEN 'FLOAT' WHEN arrow_type LIKE 'int%' THEN 'INT'
                     ELSE 'VARCHAR' END AS sql_type
         FROM cols WHERE dropped IS NULL),
tabs AS (SELECT table_id, any_value(chunk) AS chunk, any_value(member) AS member, max(n_rows) AS n_rows, count(*) AS n_cols,
                bool_and(kind IN {NUMERIC}) AND bool_or(kind IN {FLOATING}) AS kv_floats
         FROM kept GROUP BY table_id),
cell AS (SELECT l.table_id, l.ord, k.i, k.name, k.kind, k.sql_type, t.n_cols, t.kv_floats, t.n_rows,
                CASE WHEN k.kind = 'int_nullable' THEN l.cell::DOUBLE::VARCHAR ELSE l.cell END AS cell,
                {md_type()} AS md_type
         FROM long l JOIN kept k USING (table_id, pos) JOIN tabs t USING (table_id))"""


def time_text(mode: str) -> str:
    return (
        f"CASE {mode} WHEN 'date' THEN left(cell, 10) "
        "WHEN 'micro' THEN CASE WHEN contains(cell, '.') THEN cell ELSE cell || '.000000' END "
        "WHEN 'milli' THEN CASE WHEN contains(cell, '.') THEN left(cell, 23) ELSE cell || '.000' END "
        "ELSE cell END"
    )


def time_mode(over: str) -> str:
    """The common precision of the timestamps in a window or group."""
    return (
        f"CASE WHEN bool_and(cell LIKE '% 00:00:00') {over} THEN 'date' "
        f"WHEN bool_or(contains(cell, '.') AND cell NOT LIKE '%000') {over} THEN 'micro' "
        f"WHEN bool_or(contains(cell, '.')) {over} THEN 'milli' ELSE 'plain' END"
    )


def csv_cell(mode: str) -> str:
    return (
        f"CASE WHEN cell IS NULL THEN '' WHEN kind = 'time' THEN {time_text(mode)} "
        f"ELSE {quote('cell')} END"
    )


def json_cell() -> str:
    return (
        f"'\"' || {escape('name')} || '\": ' || CASE "
        f"WHEN cell IS NULL AND kind IN {NUMERIC} THEN 'NaN' WHEN cell IS NULL AND kind = 'time' THEN '\"NaT\"' "
        "WHEN cell IS NULL THEN 'null' WHEN kind = 'int' THEN cell "
        f"WHEN kind IN {FLOATING} THEN replace(cell, 'inf', 'Infinity') "
        "WHEN kind IN ('bool', 'bool_object') THEN lower(cell) "
        f"ELSE '\"' || {escape('cell')} || '\"' END"
    )


def phrase() -> str:
    return (
        f"CASE WHEN cell IS NULL OR {tokens('cell')} = 0 THEN NULL ELSE 'The ' || name || ' is ' || "
        "CASE WHEN kind = 'int' AND kv_floats THEN cell::DOUBLE::VARCHAR ELSE cell END END"
    )


def strip(text: str) -> str:
    return f"trim({text}, '{SPACES}')"


def breaks(text: str) -> str:
    return f"coalesce(contains({text}, chr(10)) OR contains({text}, chr(13)), false)"


def md_number(text: str) -> str:
    return f"try_cast(replace({strip(text)}, '_', '') AS DOUBLE)"


def md_type() -> str:
    """Type of one cell for Markdown: 1 none or boolean, 2 whole number, 3 number, 4 text."""
    digits = "[0-9]+(_[0-9]+)*"
    number = rf"[-+]?({digits}\.?({digits})?|\.{digits})([eE][-+]?{digits})?"
    return (
        f"CASE WHEN k.kind IN {FLOATING} OR (k.kind = 'int' AND t.kv_floats) THEN 3 WHEN k.kind = 'int' THEN 2 "
        "WHEN k.kind <> 'object' THEN 4 WHEN l.cell IS NULL OR l.cell IN ('True', 'False') THEN 1 "
        f"WHEN regexp_full_match({strip('l.cell')}, '[-+]?{digits}') THEN 2 "
        f"WHEN regexp_full_match({strip('l.cell')}, '{number}') AND isfinite({md_number('l.cell')}) THEN 3 "
        "WHEN lower(l.cell) IN ('inf', '-inf', 'nan') THEN 3 ELSE 4 END"
    )


def md_text(kind: str) -> str:
    """A cell as it prints in a column of type `kind`."""
    return (
        f"CASE WHEN cell IS NULL THEN CASE WHEN kind IN {NUMERIC} THEN 'nan' WHEN kind = 'time' THEN 'NaT' ELSE '' END "
        f"WHEN {kind} = 3 AND cell NOT IN ('True', 'False') THEN coalesce(format('{{:g}}', {md_number('cell')}), 'nan') "
        f"WHEN {kind} = 4 THEN {strip('cell')} ELSE cell END"
    )


def md_after(text: str) -> str:
    """Characters after the point, or after an exponent's sign."""
    return (
        f"CASE WHEN NOT regexp_matches({text}, '^[-+]?[0-9]') THEN -1 WHEN contains({text}, '.') THEN length({text}) - strpos({text}, '.') "
        f"WHEN contains({text}, 'e') THEN length({text}) - strpos({text}, 'e') ELSE -1 END"
    )


def md_width(text: str) -> str:
    return f"coalesce(list_max(list_transform(regexp_split_to_array({text}, '[\\r\\n]'), lambda x: length(x))), 0)"


NEWLINE = "[\\r\\n]"
LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]"


def md_slices(name: str, source: str, keys: str) -> str:
    """Markdown of slices of `source` told apart by `keys`: `<name>_lines(keys, ord, markdown)`, `<name>_tops(keys, md)`."""
    column = f"PARTITION BY {keys}, i"
    after = md_after("md_text")
    return f"""{name}_1 AS (SELECT *, max(md_type) OVER ({column}) AS shown,
     bool_or({breaks('cell')} OR {breaks('name')}) OVER (PARTITION BY {keys}) AS stacked FROM {source}),
{name}_2 AS (SELECT *, {md_text('shown')} AS md_text FROM {name}_1),
{name}_3 AS (SELECT * REPLACE (CASE WHEN shown = 3 THEN md_text || repeat(' ', (max({after}) OVER ({column}) - {after})::BIGINT)
     ELSE md_text END AS md_text) FROM {name}_2),
{name}_4 AS (SELECT *, greatest({md_width('name')} + 2, max({md_width('md_text')}) OVER ({column})) AS width FROM {name}_3),
{name}_lines AS (SELECT {keys}, ord, {md_line('stacked')} AS markdown FROM (
     SELECT {keys}, ord, any_value(stacked) AS stacked, {md_cells('md_text', LINE_BREAK)} AS ps FROM {name}_4 GROUP BY ALL)),
{name}_tops AS (SELECT {keys}, {md_line('stacked')} || chr(10) || '|' || rules || '|' AS md FROM (
     SELECT {keys}, bool_or({breaks('name')}) AS stacked, {md_cells('name', NEWLINE)} AS ps,
       string_agg({md_rule('width')}, '|' ORDER BY i) AS rules
     FROM (SELECT DISTINCT ON ({keys}, i) * FROM {name}_4) GROUP BY ALL))"""


def md_cells(text: str, pattern: str) -> str:
    """The cells of a line, whole and in pieces, with width and type of their columns."""
    parts = f"regexp_split_to_array({text}, '{pattern}')"
    parts = f"CASE WHEN len({parts}) > 1 AND {parts}[-1] = '' THEN {parts}[:-2] ELSE {parts} END"
    return f"list({{'whole': {text}, 'parts': {parts}, 'width': width, 'shown': shown}} ORDER BY i)"


def md_line(stacked: str) -> str:
    """The one or more lines of the cells in `ps`."""

    def joined(text: str) -> str:
        fill = f"repeat(' ', greatest(0, p.width - length({text}))::BIGINT)"
        padded = f"CASE WHEN p.shown IN (2, 3) THEN {fill} || {text} ELSE {text} || {fill} END"
        return f"'| ' || array_to_string(list_transform(ps, lambda p: {padded}), ' | ') || ' |'"

    most = "list_max(list_transform(ps, lambda p: len(p.parts)))"
    piece = joined("coalesce(p.parts[k], '')")
    stack = f"list_transform(range(1, {most} + 1), lambda k: {piece})"
    return f"CASE WHEN {stacked} THEN array_to_string({stack}, chr(10)) ELSE {joined('p.whole')} END"


def md_rule(width: str) -> str:
    dashes = f"repeat('-', (({width}) + 1)::BIGINT)"
    return f"CASE WHEN shown IN (2, 3) THEN {dashes} || ':' ELSE ':' || {dashes} END"


OWN_MODE = (
    "CASE WHEN cell LIKE '% 00:00:00' THEN 'date' WHEN contains(cell, '.') AND cell NOT LIKE '%000' "
    "THEN 'micro' WHEN contains(cell, '.') THEN 'milli' ELSE 'plain' END"
)


def lone(text: str) -> str:
    return f"CASE WHEN any_value(n_cols) = 1 AND {text} = '' THEN '\"\"' ELSE {text} END"


def row_texts(spec: Spec) -> str:
    """`texts`: one row per table row with its own text in each format."""
    csv = f"string_agg({csv_cell(OWN_MODE)}, ',' ORDER BY i)"
    return f"""{cells(spec)},
{md_slices('md', '(SELECT *, ord AS row FROM cell)', 'table_id, row')},
texts AS (SELECT * FROM (SELECT table_id, ord, any_value(n_rows) AS n_rows,
  {lone(csv)} AS csv,
  '{{' || string_agg({json_cell()}, ', ' ORDER BY i) || '}}' AS json,
  string_agg({phrase()}, '. ' ORDER BY i) || '.' AS keyvalue
  FROM cell GROUP BY table_id, ord) JOIN (SELECT table_id, ord, markdown FROM md_lines) USING (table_id, ord))"""


def costs(spec: Spec) -> str:
    """`costs(table_id, format, ord, cost, header)` for all formats."""
    csv_names = f"string_agg({quote('name')}, ',' ORDER BY i) || chr(10)"
    created = (
        "'CREATE TABLE data (' || chr(10) || string_agg('    \"' || name || '\" ' || sql_type, "
        "',' || chr(10) ORDER BY i) || chr(10) || ');' || chr(10)"
    )
    return f"""{row_texts(spec)},
heads AS (SELECT table_id, h_csv, h_sql, md AS h_md FROM (
            SELECT table_id, {csv_names} AS h_csv, {created} || {csv_names} || {csv_names} AS h_sql
            FROM cell WHERE ord = 0 GROUP BY table_id) JOIN md_tops USING (table_id) WHERE md_tops.row = 0),
headers AS (
  SELECT table_id, 'csv' AS format, {tokens('h_csv')} AS header FROM heads
  UNION ALL SELECT table_id, 'json', {tokens("'[]'")} FROM heads
  UNION ALL SELECT table_id, 'keyvalue', 0 FROM heads
  UNION ALL SELECT table_id, 'markdown', {tokens('h_md')} FROM heads
  UNION ALL SELECT table_id, 'sql_schema', {tokens('h_sql')} FROM heads),
row_costs AS (
  SELECT table_id, ord, 'csv' AS format, {tokens('csv')} AS cost FROM texts
  UNION ALL SELECT table_id, ord, 'json', greatest(1, {tokens("('[' || json || ']')")} - 1) FROM texts
  UNION ALL SELECT table_id, ord, 'keyvalue', coalesce({tokens('keyvalue')}, 0) FROM texts
  UNION ALL SELECT table_id, ord, 'markdown', {tokens('markdown')} FROM texts
  UNION ALL SELECT table_id, ord, 'sql_schema', {tokens('csv')} FROM texts),
costs AS (SELECT * FROM row_costs JOIN headers USING (table_id, format))"""


def packed(spec: Spec, budget: int) -> str:
    """`packed(table_id, format, ord, seg)`: the greedy walk, one recursion step per row."""
    over = f"n.cost > {budget} - n.header"
    full = f"w.cur + n.cost > {budget}"
    return f"""{costs(spec)},
walk AS (
  SELECT table_id, format, ord, CASE WHEN cost > {budget} - header THEN header ELSE header + cost END AS cur,
         cost <= {budget} - header AS is_open, 0 AS seg,
         CASE WHEN cost > {budget} - header THEN NULL ELSE 0 END AS row_seg
  FROM costs WHERE ord = 0
  UNION ALL
  SELECT n.table_id, n.format, n.ord,
         CASE WHEN {over} THEN n.header WHEN {full} THEN n.header + n.cost ELSE w.cur + n.cost END,
         NOT ({over}),
         CASE WHEN {over} THEN w.seg + w.is_open::INT WHEN {full} THEN w.seg + 1 ELSE w.seg END,
         CASE WHEN {over} THEN NULL WHEN {full} THEN w.seg + 1 ELSE w.seg END
  FROM walk w JOIN costs n ON n.table_id = w.table_id AND n.format = w.format AND n.ord = w.ord + 1),
packed AS (SELECT table_id, format, ord, row_seg AS seg FROM walk)"""


def slices(source: str) -> str:
    """`slice_text(table_id, format, seg, text)` from `source(table_id, format, ord, seg)`."""
    group = "PARTITION BY table_id, format, seg, i"
    low, high = f"min(v) OVER ({group})", f"max(v) OVER ({group})"
    ilow, ihigh = f"min(w) OVER ({group})", f"max(w) OVER ({group})"
    return f"""
sl AS (SELECT s.format, s.seg, c.*, CASE WHEN sql_type = 'FLOAT' THEN cell::DOUBLE END AS v,
              CASE WHEN sql_type = 'INT' THEN cell::DOUBLE::DECIMAL(38,0) END AS w
       FROM cell c JOIN {source} s USING (table_id, ord) WHERE s.seg IS NOT NULL),
sw AS (SELECT *, {time_mode(f'OVER ({group})')} AS mode,
         CASE WHEN count(cell) OVER ({group}) = 0 THEN ''
              WHEN sql_type = 'FLOAT' THEN ' -- range: ' || format('{{:.3g}}', {low}) || ' to ' || format('{{:.3g}}', {high})
              WHEN sql_type = 'INT' THEN ' -- range: ' || ({ilow})::VARCHAR || ' to ' || ({ihigh})::VARCHAR
              ELSE '' END AS bounds
       FROM sl),
{md_slices('part', "(SELECT * FROM sl WHERE format = 'markdown')", 'table_id, format, seg')},
lines AS (SELECT table_id, format, seg, ord, CASE format
     WHEN 'json' THEN '{{' || string_agg({json_cell()}, ', ' ORDER BY i) || '}}'
     WHEN 'keyvalue' THEN string_agg({phrase()}, '. ' ORDER BY i) || '.'
     WHEN 'markdown' THEN ''
     ELSE {lone(f"string_agg({csv_cell('mode')}, ',' ORDER BY i)")} END AS line
   FROM sw GROUP BY table_id, format, seg, ord),
bodies AS (SELECT table_id, format, seg, min(ord) AS start_ord, max(ord) + 1 AS end_ord,
     CASE WHEN format = 'json' THEN string_agg(line, ', ' ORDER BY ord)
          ELSE string_agg(coalesce(markdown, line), chr(10) ORDER BY ord) END AS body
   FROM lines LEFT JOIN part_lines USING (table_id, format, seg, ord) GROUP BY table_id, format, seg),
tops AS (SELECT table_id, format, seg,
     string_agg({quote('name')}, ',' ORDER BY i) || chr(10) AS names,
     'CREATE TABLE data (' || chr(10) || string_agg('    "' || name || '" ' || sql_type || bounds,
        ',' || chr(10) ORDER BY i) || chr(10) || ');' || chr(10) AS created
   FROM (SELECT DISTINCT ON (table_id, format, seg, i) * FROM sw) GROUP BY table_id, format, seg),
slice_text AS (SELECT table_id, format, seg, start_ord, end_ord, CASE format
     WHEN 'csv' THEN rtrim(names || body, chr(10))
     WHEN 'json' THEN '[' || body || ']'
     WHEN 'keyvalue' THEN coalesce(body, '')
     WHEN 'markdown' THEN md || chr(10) || body
     ELSE created || names || body || chr(10) END AS text
   FROM bodies JOIN tops USING (table_id, format, seg) LEFT JOIN part_tops USING (table_id, format, seg))"""
