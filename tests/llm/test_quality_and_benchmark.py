import corpus_pipeline
from pyspark.sql import functions as F
from tests.llm import brute
from tests.llm.conftest import table

from tablemill.llm import decontaminate, quality


def test_measures(docs, rows):
    names = list(quality.measures(F.col("text")))
    found = docs.select("doc_id", "text", *[c.alias(k) for k, c in quality.measures(F.col("text")).items()])
    expected = [(d, t, *brute.quality(t)[:5]) for d, t in rows]
    assert table(found, "doc_id", "text", *names) == sorted(expected, key=repr)


def test_cascade_order_changes_no_verdict(docs, rows):
    rules = quality.rules(F.col("text"))
    expected = sorted([(d, t) for d, t in rows if brute.quality(t)[6]], key=repr)
    assert 0 < len(expected) < len(rows)
    for ordered in (list(rules.items()), list(rules.items())[::-1], quality.order_rules(docs, rules)):
        assert sorted(dict(ordered)) == sorted(rules)
        kept = docs.where(quality.cascade(ordered).isNull())
        assert table(kept, "doc_id", "text") == expected


def test_keep_good(docs, clashing, empty, rows):
    expected = sorted([(d, t) for d, t in rows if brute.quality(t)[6]], key=repr)
    assert table(quality.keep_good(docs), "doc_id", "text") == expected
    assert table(quality.keep_good(clashing), "doc_id", "text") == expected
    assert quality.keep_good(clashing).columns == clashing.columns
    assert quality.keep_good(empty).count() == 0


ITEMS = [
    (1, "alpha beta the of and tion reon x don't R2D2 naïve tag a b the the of and"), (2, None), (3, ""), (4, "one two THREE"),
    (5, "one two three"), (None, "the of"), (6, "日本"), (7, "!!! ??"),
]


def items_from(rows):
    """Items, one of which is a passage of a document."""
    text = next(t for d, t in rows if d == -4)
    return [*ITEMS, (8, text), (9, "  ".join(text.split()[5:25]).upper())]


def check(found, rows, items):
    found = found.select("doc_id", "found.*", decontaminate.contaminated().alias("c"))
    expected = brute.decontaminate(rows, [x for x in items if x[0] is not None])
    assert table(found, "doc_id", "n_words", "n_hit", "items", "c") == sorted(expected, key=repr)


def test_decontamination(spark, docs, clashing, empty, rows):
    items = items_from(rows)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    check(decontaminate.find(docs, benchmark), rows, items)
    check(decontaminate.find(clashing, benchmark), rows, items)
    assert decontaminate.find(empty, benchmark).count() == 0
    check(decontaminate.find(docs, benchmark.limit(0)), rows, [])
    assert any(c for *_, c in brute.decontaminate(rows, [x for x in items if x[0] is not None]))


def test_blocks_of_patterns(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 150)
    items = items_from(rows)
    check(decontaminate.find(docs, spark.createDataFrame(items, "item_id long, text string")), rows, items)


def test_original_ranges(spark):
    text = "Ünder: ONE,  two -- Three! more"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = decontaminate.find(docs, spark.createDataFrame([(4, "one two three")], "item_id long, text string"))
    (span,) = found.first()["found"]["ranges"]
    assert text.encode()[span["start"] : span["end"]].decode() == "ONE,  two -- Three"


def test_drop_contaminated(spark, docs, rows):
    items = items_from(rows)
    kept = decontaminate.drop_contaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == docs.columns
    judged = brute.decontaminate(rows, [x for x in items if x[0] is not None])
    assert table(kept, "doc_id", "text") == sorted([r for r, j in zip(rows, judged, strict=True) if not j[4]], key=repr)


def test_items_without_id_count(spark, tmp_path):
    words = " ".join(f"w{k}" for k in range(15))
    items = [(None, words), (3, "w0 w1"), (None, "w0 w1"), (None, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, f"x {words} y"), (2, "nothing here"), (4, "w0 w1")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = decontaminate.op7_benchmark_decontamination(spark, str(tmp_path))
    assert table(found, "doc_id", "n_hit", "n_items", "contaminated") == [(1, 15, 1, True), (2, 0, 0, False), (4, 2, 1, True)]
    kept = corpus_pipeline.benchmark_decontamination(spark, docs.where("doc_id < 4"), str(tmp_path))
    assert table(kept, "doc_id") == [(2,)]
