import glob
import hashlib
import os

import corpus_pipeline
import numpy as np
import pytest
from tests.llm import brute
from pyspark.sql import functions as F
from tests.llm.conftest import SCHEMA, table

from tablemill.llm import units
from tablemill.llm.catalog import QUERIES, SQL
from tablemill.llm.common import public_tokenizer


def test_pipeline_against_plain_python(spark, rows, tmp_path):
    # Among them several texts under one id and several without any.
    plain = [t for _, t in rows if t and brute.quality(t)[6]]
    rows = [*rows, (None, plain[7][:900]), (None, plain[11] + " and more"), (rows[6][0], plain[9][5:]), (None, plain[7][:900])]
    docs = spark.createDataFrame([(i, t, None, "s", None if t is None else len(t)) for i, t in rows], SCHEMA).repartition(3)
    spark.createDataFrame([(1, " ".join(brute.words(t)[:40])) for d, t in rows if d == 12], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet"
    )
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, " ".join(brute.words(t)[:40])) for d, t in rows if d == 12]
    left = [(d, t) for d, t in rows if brute.quality(t)[6]]
    hashes = {r["text"]: r["h"] for r in spark.createDataFrame([(t,) for _, t in left], "text string").withColumn("h", F.xxhash64("text")).collect()}
    chosen = {}
    for root, (doc, text) in zip(brute.near_components(left)[0], left, strict=True):
        chosen[root] = min(chosen.get(root, (1 << 63, 0, "")), (brute.key(doc), hashes[text], text))
    kept = [(None if doc == brute.key(None) else doc, text) for doc, _, text in chosen.values()]
    assert None in [doc for doc, _ in kept] and len({doc for doc, _ in kept}) < len(kept)
    cut = [(d, k if n else t) for (d, t), (_, _, n, k) in zip(kept, brute.substring_dedup(kept), strict=True)]
    judged = brute.decontaminate(cut, items)
    left = [x for x, j in zip(cut, judged, strict=True) if not j[4]]
    tokenizer = units.load(public_tokenizer("word_bpe_49k.json"))
    ids = [tokenizer.encode(t, add_special_tokens=False).ids for _, t in left]
    expected = [(d, len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest()) for (d, _), i in zip(left, ids, strict=True)]
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert table(found, "doc_id", "n_tokens", "ids_sha256") == sorted(expected, key=repr)
    assert 5 < len(expected) < len(rows)


def test_stages_keep_the_columns(spark, docs, empty, tmp_path):
    spark.createDataFrame([(1, "the of and")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, function in corpus_pipeline.STAGES[:-1]:
        assert function(spark, docs, str(tmp_path)).columns == docs.columns, name
        assert function(spark, empty, str(tmp_path)).count() == 0, name


FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    found = QUERIES[name](spark, FOLDER)
    columns = sorted(found.columns)
    answer = con.execute(SQL[name])
    assert sorted(d[0] for d in answer.description) == columns
    order = [[d[0] for d in answer.description].index(c) for c in columns]
    assert table(found, *columns) == sorted([tuple(r[i] for i in order) for r in answer.fetchall()], key=repr)
