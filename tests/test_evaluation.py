"""Pairs that must be true, responses that must be refused, runs without checkpoints, order of rows."""

import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tablemill.operators import fit, pairs, runs
from tablemill.operators.order import by_position, shuffle_rows
from tablemill.plans.serialize import prepare
from tablemill.sources.corpus import corpus_from_tables

TABLES = {
    "plain": [("A", 1.0, 5.0), ("B", 2.5, 7.0), ("C", 0.001, 1.0)],
    "ties": [("A", 1.0, 2.0), ("B", 1.0, 2.0), ("C", 1.0, 2.0)],
    "tied top": [("A", 3.0, 9.0), ("B", 3.0, 9.0), ("C", 1.0, 2.0)],
    "labels": [("A", 1.0, 2.0), ("A", 4.0, 3.0), ("B", 4.0, 1.0), ("B", 1.0, 1.0)],
    "digits": [("A", 0.001, 1.0), ("B", 0.002, 2.0)],
    "huge": [("A", 1e18, 1.0), ("B", 1.0, 2.0)],
    "beyond": [("A", 1e300, 1.0), ("B", 2.0, 2.0)],
    "gaps": [("A", None, 1.0), (None, 7.0, 2.0), ("B", 2.0, None), ("C", 3.0, 4.0), ("D", 5.0, 6.0)],
}


def holds(rows, text):
    """Whether a sentence is true of a table, by its own words."""
    number = lambda t: Fraction(t)
    if m := re.fullmatch(r"The total x is (.+)\.", text):
        return sum(Fraction(str(x)) for _, x, _ in rows if x is not None) == number(m[1])
    if m := re.fullmatch(r"The x of (\w+) is (.+)\.", text):
        return any(n == m[1] and x is not None and Fraction(str(x)) == number(m[2]) for n, x, _ in rows)
    if m := re.fullmatch(r"(\w+) has a higher x than (\w+)\.", text):
        return any(p == m[1] and q == m[2] and u is not None and v is not None and u > v for p, u, _ in rows for q, v, _ in rows)
    best = max(y for n, x, y in rows if None not in (n, x, y))
    if m := re.fullmatch(r"The highest y belongs to (\w+)\.", text):
        return any(n == m[1] and y == best for n, _, y in rows)
    m = re.fullmatch(r"The x in the row with the highest y is (.+)\.", text)
    return any(y == best and x is not None and Fraction(str(x)) == number(m[1]) for _, x, y in rows)


@pytest.mark.parametrize("split_rows", [1_000_000, 1])
def test_template_pairs_are_true_and_false(spark, split_rows):
    rows = [(name, i, *r) for name, table in TABLES.items() for i, r in enumerate(table)]
    df = spark.createDataFrame(rows, "t string, i int, name string, x double, y double")
    corpus = corpus_from_tables(df, F.col("t"), F.lit(1), ["name", "x", "y"], row_key=["i"])
    made = pairs.template_pairs(*prepare(corpus, split_rows)).collect()
    kinds = {}
    for r in made:
        name = r.table_id.split("__")[1]
        kinds.setdefault(name, set()).add(r.type)
        assert holds(TABLES[name], r.statement), (name, r)
        assert not holds(TABLES[name], r.distractor), (name, r)
    assert len(kinds["plain"]) == 5 and kinds["ties"] == {"aggregation"}
    assert "aggregation" not in kinds["beyond"] and "aggregation" in kinds["huge"]


GOOD = '{"pairs": [{"statement": "s", "distractor": "d", "type": "lookup"}]}'


@pytest.mark.parametrize(
    "response,readable",
    [
        (GOOD, True), (f"```json {GOOD} ```", True), (f"Here: {GOOD}", True), (f"{GOOD} I hope this helps.", False), (GOOD + GOOD, False),
        (f"{GOOD}, {GOOD}", False), (GOOD.replace('"', "'"), False), ("[]", False), ("", False), (None, False), (GOOD[:30], False),
    ],
)
def test_responses_are_read_strictly(spark, response, readable):
    rows = spark.createDataFrame([("t", 1, response)], "table_id string, attempt int, response string")
    found = pairs.parse_responses(rows).first()["pairs"]
    assert (found is not None) == readable
    assert not readable or found[0]["statement"] == "s"


def test_experiments_without_checkpoints_stay(spark):
    paths = [("scratch", "tabular-json-1p5b-1/checkpoints/logs"), ("scratch", "tabular-csv-1p5b-2/checkpoints/iter_0000100")]
    dirs = runs.checkpoint_dirs(spark.createDataFrame(paths, "location string, path string"))
    found = runs.reached_target(runs.parse_experiments(runs.merge_locations(runs.checkpoint_iters(dirs))))
    assert {(r.format, r.reached, tuple(r.iters)) for r in found.collect()} == {("json", "NONE", ()), ("csv", "no(100)", (100,))}
    counted = {r.format: (r.n_runs, r.n_done) for r in runs.format_completeness(found).collect()}
    assert counted["json"] == (1, 0) and counted["markdown"] == (0, 0)
    assert "json" not in {r.format for r in runs.missing_formats_runs(found).collect()}


@pytest.mark.parametrize("split_rows", [1_000_000, 4])
def test_evaluation_takes_rows_as_they_stand(spark, split_rows):
    rows = [(i * 10 - 50, f"w{i}") for i in range(30)]
    df = spark.createDataFrame(rows, "id long, a string").repartition(7)
    p = prepare(corpus_from_tables(df, F.lit("t"), F.lit(1), ["a"], row_key=["id"]), split_rows)
    text = {r.format: r.text for r in fit.fit_rows(*p, 12).collect()}
    assert text["csv"].split() == ["a", *[f"w{i}" for i in range(11)]]
    own = by_position(p.corpus, p.large)
    assert [r.cells[0] for r in shuffle_rows(own.rows, p.large, True).orderBy("ord").collect()] == [f"w{i}" for i in range(30)]


def test_order_needs_positions(spark):
    df = spark.createDataFrame([("a",), ("b",)], "a string")
    own = by_position(corpus_from_tables(df, F.lit("t"), F.lit(1)))
    with pytest.raises(Exception, match="no position"):
        shuffle_rows(own.rows, None, False).collect()


def test_long_texts_survive_the_shuffle(spark):
    df = spark.createDataFrame([(1, "x" * 600)], "id long, a string")
    rows = shuffle_rows(corpus_from_tables(df, F.lit("t"), F.lit(1), ["a"], row_key=["id"]).rows, None, True)
    assert len(rows.first()["cells"][0]) == 600


def test_plan_from_tables_to_files(spark, tmp_path):
    import json

    from tablemill.constants import FORMATS, PAIR_TYPES
    from tablemill.plans import evaluate

    rows = [(t, i, f"w{t}-{i}", float(i)) for t in range(6) for i in range(1 if t == 5 else 4)]
    df = spark.createDataFrame(rows, "t int, i long, name string, x double")
    p = prepare(corpus_from_tables(df, F.concat(F.lit("t"), "t"), F.lit(1), ["name", "x"], row_key=["i"]))
    done = spark.createDataFrame([("chunk0001__t0",)], "table_id string")
    chosen = evaluate.choose(p, done, budget=200, n_tables=10)
    asked = sorted(r.table_id for r in chosen.prompts.collect())
    assert asked == [f"chunk0001__t{t}" for t in range(1, 5)]  # one is done, one has a single row
    assert all("w1-0" in r.user for r in chosen.prompts.collect() if r.table_id.endswith("t1"))
    whole = json.dumps({"pairs": [{"statement": f"s {k}", "distractor": f"d {k}", "type": k} for k in PAIR_TYPES]})
    answers = [(t, 1, whole if t != asked[0] else "no") for t in asked] + [("chunk0001__t9", 1, whole)]
    outcome = evaluate.finish(chosen, spark.createDataFrame(answers, "table_id string, attempt int, response string"))
    assert [r.table_id for r in outcome.failed.collect()] == [asked[0]]
    assert outcome.fanned.count() == 3 * len(PAIR_TYPES) * len(FORMATS)
    evaluate.write(chosen, outcome, str(tmp_path))
    kept = evaluate.stored(spark, str(tmp_path))
    assert sorted(r.table_id for r in kept.completed.collect()) == asked  # the failed one isn't asked again
    first = kept.clean_tables.filter(F.col("table_id") == asked[1]).orderBy("ord").collect()
    assert [r.cells[0] for r in first] == [f"w2-{i}" for i in range(4)]
    assert kept.clean_tables.select("table_id").distinct().count() == 3
    again = evaluate.choose(p, kept.completed, 200, 10)
    assert sorted(r.table_id for r in again.prompts.collect()) == ["chunk0001__t0"]


def test_an_interrupted_write_resumes_without_duplicates(spark, tmp_path, monkeypatch):
    import json

    from tablemill.constants import FORMATS, PAIR_TYPES
    from tablemill.plans import evaluate
    from tablemill.sources import commits, files

    folder = str(tmp_path)
    rows = [(t, i, f"w{t}-{i} " + "long " * (90 if t == 3 else 0), float(i)) for t in range(4) for i in range(4)]
    df = spark.createDataFrame(rows, "t int, i long, name string, x double")
    p = prepare(corpus_from_tables(df, F.concat(F.lit("t"), "t"), F.lit(1), ["name", "x"], row_key=["i"]))
    whole = json.dumps({"pairs": [{"statement": f"s {k}", "distractor": f"d {k}", "type": k} for k in PAIR_TYPES]})

    def answered(completed, ids):
        chosen = evaluate.choose(p, completed, 60, 10)
        answers = spark.createDataFrame([(t, 1, whole) for t in ids], "table_id string, attempt int, response string")
        return chosen, evaluate.finish(chosen, answers)

    first = answered(None, ["chunk0001__t0"])
    evaluate.write(*first, folder, "a")
    evaluate.write(*first, folder, "a")  # a batch that is there adds nothing
    second = answered(evaluate.stored(spark, folder).completed, ["chunk0001__t1"])
    for sink in ("write_ground_truth", "write_clean_tables", "append_completed"):
        with monkeypatch.context() as broken:
            broken.setattr(files, sink, lambda *_: (_ for _ in ()).throw(OSError("stopped")))
            with pytest.raises(OSError):
                evaluate.write(*second, folder)
    with monkeypatch.context() as broken:
        broken.setattr(commits, "commit", lambda *_: (_ for _ in ()).throw(OSError("stopped")))
        with pytest.raises(OSError):
            evaluate.write(*second, folder, "b")
    kept = evaluate.stored(spark, folder)
    assert kept.pairs.count() == len(PAIR_TYPES) * len(FORMATS)
    assert "chunk0001__t1" not in {r.table_id for r in kept.completed.collect()}
    evaluate.write(*second, folder, "b")
    kept = evaluate.stored(spark, folder)
    assert kept.pairs.count() == kept.pairs.distinct().count() == 2 * len(PAIR_TYPES) * len(FORMATS)
    assert kept.ground_truth.count() == 2 * len(PAIR_TYPES)
    assert {r.table_id for r in kept.clean_tables.collect()} == {"chunk0001__t0", "chunk0001__t1"}
    # The third table waits for an answer; the fourth has a cell too long for the budget in some format and is finished.
    assert {r.table_id for r in evaluate.choose(p, kept.completed, 60, 10).prompts.collect()} == {"chunk0001__t2"}


def test_results_of_committed_batches(spark, tmp_path):
    from tablemill.sources import commits, files

    rows = [("r", "csv", "t", "lookup", f"s{i}", "d", 1.0, 2.0, True) for i in range(3)]
    results = spark.createDataFrame(rows, files.RESULT_LINES)
    path, log = f"{tmp_path}/results", f"{tmp_path}/log"
    assert files.read_results(spark, path, log).count() == 0
    files.write_results(results, path, "1")
    assert files.read_results(spark, path, log).count() == 0
    commits.commit(spark, log, "1")
    files.write_results(results, path, "2")
    files.write_results(results, path, "2")
    commits.commit(spark, log, "2")
    commits.commit(spark, log, "2")
    found = files.read_results(spark, path, log)
    assert found.columns == results.columns and found.count() == 6 and commits.committed(spark, log) == ["1", "2"]
