"""The evaluation plan as a whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablemill.catalog import sql as S
from tablemill.catalog.corpora import NUMBERS, prepared
from tablemill.catalog.registry import query
from tablemill.catalog.tables import SMALL, fit_sql, with_
from tablemill.constants import SAMPLE_SEED
from tablemill.plans import evaluate

N_TABLES = 300
DONE = "substr(md5(table_id), 1, 1) IN ('0', '1')"
CHOSEN = (
    f"{fit_sql(S.positioned(NUMBERS), SMALL)}, valid AS (SELECT table_id FROM headers JOIN tabs USING (table_id) "
    f"GROUP BY table_id HAVING max(header) < {SMALL} AND any_value(n_rows) >= 2), "
    f"sampled AS (SELECT table_id FROM (SELECT table_id FROM valid ORDER BY md5('{SAMPLE_SEED}-' || table_id), table_id LIMIT {N_TABLES}) WHERE NOT {DONE})"
)


@query("evaluation_plan", with_(CHOSEN, "SELECT table_id, format, fit_n FROM fits JOIN sampled USING (table_id)"))
def chosen(spark, sf):
    p = prepared(spark, sf, NUMBERS)
    done = p.tables.select("table_id").filter(F.expr(DONE))
    return evaluate.choose(p, done, SMALL, N_TABLES).fitted.select("table_id", "format", "fit_n")
