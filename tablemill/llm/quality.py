"""Quality rules as a short-circuit cascade: cheap rules that reject much run first.

A rule is a boolean expression over the text that rejects a document. On a sample the time and the
share of rejected documents of each rule are measured; the cascade evaluates the rules in the order of
rejections per second, and a document leaves it at the first rule that rejects it. The order changes
the cost and the name of the first rule, never the verdict. Everything is a DataFrame expression.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablemill.llm.common import let, read
from tablemill.llm.queries import query

WORD = r"[^ \x09-\x0D]+"
SPACE = r"[ \x09-\x0D]+"
#: Documents, about, that rules are timed on; it decides the order of rules only.
SAMPLE = 2_000
#: Timings of each rule, of which the shortest counts.
REPEATS = 3
#: Length of the windows in which repetition is looked for.
WINDOW = 8


@dataclass(frozen=True)
class Limits:
    """Bounds beyond which a document is rejected; the defaults leave ordinary prose alone."""

    min_words: int = 20
    max_repeat_percent: int = 30
    max_symbol_percent: int = 10
    max_dup_line_percent: int = 50
    min_letter_percent: int = 50
    max_stutter_percent: int = 50
    min_word_chars: int = 2
    max_word_chars: int = 40


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def word_chars(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, SPACE, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))


def n_dup_lines(text: Column) -> Column:
    return let(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def n_repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words in windows that stand twice or more in a text's list of words.

    Hashes tell the texts without any repeated window; in the others the windows' own words decide.
    """

    def covered(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(words) - (window - 1))
        marked = let(
            F.sort_array(F.transform(starts, lambda i: F.struct(F.array_join(F.slice(words, i, window), " ").alias("w"), i.alias("i")))),
            lambda s: F.filter(
                s,
                lambda x, k: F.coalesce(F.get(s, k - 1)["w"] == x["w"], F.lit(False))
                | F.coalesce(F.get(s, k + 1)["w"] == x["w"], F.lit(False)),
            ),
        )
        return F.aggregate(
            F.array_sort(F.transform(marked, lambda x: x["i"])),
            F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last")),
            lambda a, i: F.struct((a["n"] + F.least(F.lit(window), i - a["last"])).alias("n"), i.alias("last")),
            lambda a: a["n"],
        )

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (window - 1)), lambda i: F.xxhash64(F.slice(words, i, window)))
    repeats = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(F.size(words) < window, 0).when(repeats, covered(words)).otherwise(0).cast("long")


def measures(text: Column, words: Column | None = None) -> dict[str, Column]:
    """The base measures. A null text has no words; all are 0. `words` is the list of words if it is bound already."""
    body = F.coalesce(text, F.lit(""))
    return {
        "n_words": n_words(body) if words is None else F.size(words).cast("long"),
        "word_chars": word_chars(body),
        "n_symbols": n_symbols(body),
        "n_dup_lines": n_dup_lines(body),
        "n_repeat_words": let(_words(body), lambda w: n_repeat_words(w)) if words is None else n_repeat_words(words),
    }


def rules(text: Column, limits: Limits = Limits(), known: dict[str, Column] | None = None, words: Column | None = None) -> dict[str, Column]:
    """Rejecting expressions by name; `known` gives measures that are columns already, `words` the bound list of words."""
    body = F.coalesce(text, F.lit(""))
    of = measures(text, words) | (known or {})
    n = of["n_words"]
    lettered = F.regexp_count(body, F.lit(r"[^ \x09-\x0D]*\p{L}[^ \x09-\x0D]*"))

    def stuttered(w: Column) -> Column:
        return F.size(F.filter(w, lambda x, i: F.coalesce(F.get(w, i - 1) == x, F.lit(False))))

    stutter = let(_words(body), stuttered) if words is None else stuttered(words)
    return {
        "few_words": n < limits.min_words,
        "repetition": 100 * of["n_repeat_words"] > limits.max_repeat_percent * n,
        "symbols": 100 * of["n_symbols"] > limits.max_symbol_percent * n,
        "repeated_lines": 100 * of["n_dup_lines"] > limits.max_dup_line_percent * F.size(_lines(body)),
        "few_letters": 100 * lettered < limits.min_letter_percent * n,
        "stutter": 100 * stutter > limits.max_stutter_percent * n,
        "word_length": (of["word_chars"] < limits.min_word_chars * n) | (of["word_chars"] > limits.max_word_chars * n),
    }


def order_rules(docs: DataFrame, checks: dict[str, Column], sample: int = SAMPLE) -> list[tuple[str, Column]]:
    """Rules by rejections per second on a sample of about `sample` rows, best first.

    Small jobs give each rule's time, the shortest of REPEATS since the first ones also generate and
    compile code, and its rejections; the time of a job without a rule is taken off. An empty sample
    keeps the given order.
    """
    rows = docs.count()
    part = docs.sample(fraction=min(1.0, sample / rows), seed=7).cache() if rows else docs.limit(0)
    part.count()

    def timed(check: Column) -> tuple[float, int]:
        counted, seconds = part.agg(F.count_if(check)), []
        for _ in range(REPEATS):
            begin = time.perf_counter()
            hits = counted.first()[0]
            seconds.append(time.perf_counter() - begin)
        return min(seconds), hits

    idle, _ = timed(F.lit(False))
    rate = {}
    for name, check in checks.items():
        seconds, hits = timed(check)
        rate[name] = hits / max(seconds - idle, 1e-3)
    part.unpersist()
    return sorted(checks.items(), key=lambda x: -rate[x[0]])


def cascade(ordered: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that rejects, null if none does; later rules aren't evaluated."""
    first, *rest = ordered
    chain = F.when(F.coalesce(first[1], F.lit(False)), first[0])
    for name, check in rest:
        chain = chain.when(F.coalesce(check, F.lit(False)), name)
    return chain


def first_rejection(names: list[str], text: Column, limits: Limits = Limits()) -> Column:
    """The cascade over a text whose words are listed once for all rules; they run in the order of `names`."""

    def judged(words: Column) -> Column:
        checks = rules(text, limits, words=words)
        return cascade([(name, checks[name]) for name in names])

    return let(_words(F.coalesce(text, F.lit(""))), judged)


def keep_good(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Documents that no rule rejects, with their own columns; those with null texts have no words and go."""
    ordered = order_rules(docs.select("text"), rules(F.col("text"), limits))
    return docs.where(first_rejection([name for name, _ in ordered], F.col("text"), limits).isNull())


_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, list_filter(string_split_regex(t, '[ \x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS g FROM w, unnest(generate_series(1, len(ws) - 7)) AS u(i)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g),
n AS (SELECT r, count(DISTINCT i + k) AS n FROM c, generate_series(0, 7) AS s(k) WHERE c > 1 GROUP BY r),
m AS (SELECT w.r, doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[ \x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
  CAST(len(ls) AS BIGINT) AS n_lines, len(list_filter(ws, lambda x: regexp_matches(x, '\p{L}'))) AS n_letter,
  len(list_filter(generate_series(2, len(ws)), lambda i: ws[i] = ws[i - 1])) AS n_stutter
  FROM w LEFT JOIN n ON w.r = n.r),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 50 * n_lines OR 100 * n_letter < 50 * n_words
       OR 100 * n_stutter > 50 * n_words OR word_chars < 2 * n_words OR word_chars > 40 * n_words) AS kept
FROM b
"""


@query("op6_quality_rules", _SQL)
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures of all documents and the verdict of the cascade."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    names = list(measures(F.col("text")))
    ordered = order_rules(docs.select("text"), rules(F.col("text")))
    measured = docs.withColumns(measures(F.col("text")))
    known = rules(F.col("text"), known={k: F.col(k) for k in names})
    measured = measured.withColumn("rejected_by", cascade([(k, known[k]) for k, _ in ordered]))
    base_failed = known["few_words"] | known["repetition"]
    return measured.select("doc_id", *names, base_failed.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"))
