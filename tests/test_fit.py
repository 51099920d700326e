"""Prefix fitting against rendering every prefix, with blank rows and with splits."""

import pytest
from pyspark.sql import functions as F

from tablemill.constants import FORMATS
from tablemill.operators import fit, pack, pairs
from tablemill.operators.order import by_position, shuffle_rows
from tablemill.operators.render import display_cells
from tablemill.plans.serialize import prepare, serialize
from tablemill.sources.corpus import corpus_from_tables


@pytest.mark.parametrize("split_rows", [1_000_000, 4])
def test_longest_prefix(spark, split_rows):
    rows = [(i, None if i % 3 else f"w{i} x", " " if i % 5 else "y") for i in range(30)]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    corpus = corpus_from_tables(df, F.lit("t"), F.lit(1), ["a", "b"], row_key=["id"])
    p = prepare(corpus, split_rows)
    assert (p.large is None) == (split_rows > 30)
    own = by_position(p.corpus, p.large)
    order = [r.cells for r in shuffle_rows(own.rows, p.large, True).orderBy("ord").collect()]
    assert order == [[a, b] for _, a, b in rows]
    for budget in (25, 1000) if split_rows == 4 else (1, 60):
        got = {r.format: r for r in fit.fit_rows(*p, budget).collect()}
        for fmt in FORMATS:
            n = got[fmt].fit_n
            sizes = {k: tokens(fmt, order[:k]) for k in range(1, 31)}
            best = max((k for k, size in sizes.items() if size <= budget), default=0)
            assert n == best, (fmt, budget, sizes)
            assert (got[fmt].text is None) == (best == 0)
            if best:
                assert len(got[fmt].text.split()) == sizes[best]


def tokens(fmt, cells):
    """Words of a rendered prefix of two text columns named a and b."""
    values = [[v or "" for v in row] for row in cells]
    lines = [",".join(row) for row in values]
    if fmt == "csv":
        return len("\n".join(["a,b", *lines]).split())
    if fmt == "sql_schema":
        head = 'CREATE TABLE data (\n "a" VARCHAR,\n "b" VARCHAR\n);\na,b'
        return len("\n".join([head, *lines]).split())
    if fmt == "markdown":
        return len("| a | b |\n|--|".split()) + sum(len(f"| {a} | {b} |".split()) for a, b in values)
    if fmt == "json":
        quoted = lambda v: "null" if v is None else f'"{v}"'
        return len(", ".join('{"a": %s, "b": %s}' % tuple(map(quoted, row)) for row in cells).split())
    said = [[f"The {n} is {v}" for n, v in zip("ab", row) if v and v.strip()] for row in cells]
    return len("\n".join(". ".join(s) + "." for s in said if s).split())


def test_file_tokenizer(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    from tablemill.functions.tokens import file_tokenizer

    words = ["[UNK]", ",", "|", "a", "b", "1", "x"]
    tokenizer = Tokenizer(models.WordLevel({w: i for i, w in enumerate(words)}, unk_token="[UNK]"))
    tokenizer.pre_tokenizer = pre_tokenizers.BertPreTokenizer()
    path = str(tmp_path / "tokenizer.json")
    tokenizer.save(path)
    df = spark.createDataFrame([(i, i, "x") for i in range(10)], "id int, a int, b string")
    p = prepare(corpus_from_tables(df, F.lit("t"), F.lit(1), ["a", "b"], row_key=["id"]))
    count = file_tokenizer(path)
    out = serialize(p, 20, count).filter("format = 'csv'").orderBy("seg_no").collect()
    # Header a , b and rows n , x: five rows of three tokens beside three header tokens.
    assert [r.n_rows for r in out] == [5, 5]
    assert [r.n_tokens for r in out] == [18, 18]


def _prefixes(spark, p, order):
    """The text of every prefix of one table in every format."""
    from tablemill.operators.render import prepare_columns, render_slice

    columns = prepare_columns(p.tables).select("columns", "kv_floats")
    rows = spark.createDataFrame([(n, order[:n]) for n in range(1, len(order) + 1)], "n int, rows array<array<string>>")
    each = rows.crossJoin(columns).withColumn("format", F.explode(F.array(*[F.lit(f) for f in FORMATS])))
    shown = F.transform("rows", lambda r: display_cells(r, F.col("columns")))
    text = render_slice(F.col("format"), shown, F.col("columns"), F.col("kv_floats"))
    return each.select("format", "n", text.alias("text")).collect()


@pytest.mark.parametrize("name,budgets", [("word_bpe_49k.json", (150, 700)), ("byte_bpe_50k.json", (200,))])
def test_longest_prefix_under_a_tokenizer_file(spark, name, budgets):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from tablemill.functions.tokens import file_tokenizer

    path = str(public.path(name))
    plain = Tokenizer.from_file(path)
    rows = [
        (i, f"Wörld-{i * 7919 % 1000}, \"quoted\"" * (1 + i % 3), None if i % 4 == 1 else "supercalifragilistic" * (i % 5 == 2) + " a  b", i * 1.25 if i % 3 else None, str(i * 10**i))
        for i in range(18)
    ]
    df = spark.createDataFrame(rows, "id long, a string, b string, x double, n string")
    p = prepare(corpus_from_tables(df, F.lit("t"), F.lit(1), ["a", "b", "x", "n"], row_key=["id"]))
    own = by_position(p.corpus, p.large)
    order = [r.cells for r in shuffle_rows(own.rows, p.large, True).orderBy("ord").collect()]
    texts = _prefixes(spark, p, order)
    sizes = {(r.format, r.n): len(plain.encode(r.text, add_special_tokens=False).ids) for r in texts}
    by_text = {(r.format, r.n): r.text for r in texts}
    tokenizer = file_tokenizer(path)
    for fmt in FORMATS:
        counts = [sizes[fmt, n] for n in range(1, 19)]
        assert counts == sorted(counts)
    for budget in budgets:
        got = {r.format: r for r in fit.fit_rows(*p, budget, tokenizer).collect()}
        for fmt in FORMATS:
            best = max((n for n in range(1, 19) if sizes[fmt, n] <= budget), default=0)
            assert (got[fmt].fit_n, got[fmt].text) == (best, by_text.get((fmt, best))), (fmt, budget)
    user = pairs.generation_prompts(*p, budgets[-1], tokenizer).first()["user"]
    assert by_text["markdown", max(1, got["markdown"].fit_n)] in user
    with_special = {r.format: r.fit_n for r in fit.fit_rows(*p, 150, tokenizer, special_tokens=2).collect()}
    assert with_special == {fmt: max((n for n in range(1, 19) if sizes[fmt, n] + 2 <= 150), default=0) for fmt in FORMATS}


def test_a_tokenizer_whose_tokens_span_words_needs_a_bound(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    from tablemill.functions.tokens import count_words, file_tokenizer

    tokenizer = Tokenizer(models.WordLevel({"[UNK]": 0, "a b": 1}, unk_token="[UNK]"))
    tokenizer.pre_tokenizer = pre_tokenizers.Split(",", "removed")
    path = str(tmp_path / "tokenizer.json")
    tokenizer.save(path)
    with pytest.raises(ValueError, match="span words"):
        file_tokenizer(path)
    assert file_tokenizer(path, count_words).least is count_words


@pytest.mark.parametrize("split_rows", [1_000_000, 40])
def test_rows_that_can_not_fit_are_not_rendered(spark, split_rows):
    rows = [(i, None if i % 2 else f"w{i}", " ") for i in range(400)]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    p = prepare(corpus_from_tables(df, F.lit("t"), F.lit(1), ["a", "b"], row_key=["id"]), split_rows)
    costed = pack.costed_rows(by_position(p.corpus, p.large), p.tables, p.large, after=10)
    per_split = {r["split"]: r["n"] for r in costed.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert max(per_split.values()) <= 22 and sum(per_split.values()) < 400
    got = {r.format: r.fit_n for r in fit.fit_rows(*p, 10).collect()}
    whole = {r.format: r.fit_n for r in fit.fit_rows(*p, 1000).collect()}
    assert got["csv"] == 9 and got["keyvalue"] == 4 and whole["keyvalue"] == 400


@pytest.mark.parametrize("split_rows, special, budgets", [(1_000_000, 3, (12, 75)), (4, 0, (40,))])
def test_prefixes_of_plain_rows_are_added_up(spark, split_rows, special, budgets):
    """What adds up is the search's answer: quotes, times, midnights, gaps and names of several words."""
    df = spark.sql("""SELECT id, concat('t', id % 4) AS m, if(id % 4 = 1 AND id > 9, null, '{"k": 1, "l"}') AS `a b`, id / 7 AS x,
        timestampadd(HOUR, if(id % 4 = 2, id * 4, id * 24 + 1), timestamp_ntz'2024-01-01 00:00:00') AS at FROM range(48)""")
    names = [("id", "id"), ("a b", "a b"), ("x", "x"), ("at", "at")]
    p = prepare(corpus_from_tables(df, F.col("m"), F.lit(1), names, row_key=["id"]), split_rows)
    from tablemill.functions.tokens import count_words

    key = lambda r: (r.table_id, r.format)
    for budget in budgets:
        found = fit.prefix_candidates(*p, budget, count_words, special)
        known = {r.known is not None for r in found.select("known").collect()}
        assert True in known
        summed = fit.fit_rows(*p, budget, special_tokens=special)
        searched = fit.fit_rows(*p, budget, lambda text: count_words(text), special_tokens=special)
        assert sorted(summed.collect(), key=key) == sorted(searched.collect(), key=key)
