"""The corpora the registered queries run on, each over a whole driver table.

Member and chunk are expressions that mean the same to Spark and to the SQL the
results are compared with.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablemill.plans.serialize import Prepared, prepare
from tablemill.sources.corpus import Corpus, corpus_from_tables


class Spec(NamedTuple):
    source: str
    member: str
    chunk: str
    columns: list[tuple[str, str, str]]  # name, expression, type
    row_key: list[str] | None = None
    by_position: bool = False  # whether the SQL numbers rows by their key or by the seeded hash


LINE = Spec(
    "lineitem",
    "concat('p', l_partkey, '=x.parquet')",
    "l_partkey % 26",
    [
        ("l_orderkey", "l_orderkey", "bigint"),
        ("l_partkey", "l_partkey", "bigint"),
        ("l_suppkey", "l_suppkey", "bigint"),
        ("l_linenumber", "l_linenumber", "int"),
        ("l_quantity", "l_quantity", "double"),
        ("l_extendedprice", "l_extendedprice", "double"),
        ("l_discount", "l_discount", "double"),
        ("l_tax", "l_tax", "double"),
        ("l_returnflag", "l_returnflag", "string"),
        ("l_linestatus", "l_linestatus", "string"),
        ("l_shipdate", "l_shipdate", "timestamp_ntz"),
    ],
)
NATION = Spec(
    "customer",
    "concat('nation/', c_nationkey, '=a/part.parquet')",
    "24 + c_nationkey % 2",
    [
        ("c_custkey", "c_custkey", "bigint"),
        ("c_name", "c_name", "string"),
        ("c_nationkey", "c_nationkey", "int"),
        ("c_acctbal", "c_acctbal", "double"),
        ("gap", "nullif(c_custkey % 5, 3)", "bigint"),
        ("seg,ment", "nullif(c_mktsegment, 'MACHINERY')", "string"),
        ("rich", "c_acctbal > 5000.0", "boolean"),
    ],
    ["c_custkey"],
)
EVENT = Spec(
    "events",
    "concat('u', user_id)",
    "user_id % 26",
    [
        ("event_id", "event_id", "bigint"),
        ("ts", "ts", "timestamp_ntz"),
        ("event_type", "event_type", "string"),
        ("value", "value", "double"),
        ("props", "props", "string"),
    ],
    ["event_id"],
)
TALK = Spec(
    "conversations",
    "concat('talk/', conv_id, '.parquet')",
    "conv_id % 26",
    [
        ("turn", "turn", "bigint"),
        ("role", "role", "string"),
        ("text", "text", "string"),
    ],
    ["turn"],
)
NUMBERS = Spec(
    "orders",
    "concat('c', o_custkey)",
    "o_custkey % 26",
    [
        ("o_orderkey", "o_orderkey", "bigint"),
        ("o_custkey", "o_custkey", "bigint"),
        ("o_totalprice", "o_totalprice", "double"),
    ],
    ["o_orderkey"],
)
DOCUMENT = Spec(
    "documents",
    "concat('s/', source)",
    "length(source) % 26",
    [
        ("Unnamed: 0", "doc_id", "bigint"),
        ("index", "n_chars", "bigint"),
        ("Index", "doc_id % 7", "bigint"),
        ("nothing", "nullif(lang, lang)", "string"),
        ("text", "text", "string"),
        ("lang", "lang", "string"),
        ("n_chars", "nullif(n_chars, 0)", "bigint"),
        ("rare", "nullif(doc_id % 97, 5)", "bigint"),
    ],
    ["doc_id"],
)


def source(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Tables up to this size, by the planner's estimate, are dealt out before their cells are printed, and
#: larger ones that the reader would cut into fewer pieces than there are cores.
SMALL_BYTES = 64 << 20


def dealt(df: DataFrame) -> DataFrame:
    """A small table spread over all cores: as one row group it would be read, and printed, by one task.

    Larger tables have pieces enough and stay as the reader cuts them.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    piece = df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(cores) if size <= max(SMALL_BYTES, cores * piece) else df


def corpus(spark: SparkSession, sf: str, spec: Spec) -> Corpus:
    df = dealt(source(spark, sf, spec.source))
    keys = spec.row_key or []
    named = df.select(
        F.expr(spec.member).alias("__m"),
        F.expr(spec.chunk).cast("int").alias("__c"),
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        *[F.expr(e).cast(t).alias(f"__v{i}") for i, (_, e, t) in enumerate(spec.columns)],
    )
    return corpus_from_tables(
        named,
        F.col("__m"),
        F.col("__c"),
        [(n, f"__v{i}") for i, (n, _, _) in enumerate(spec.columns)],
        [f"__k_{k}" for k in keys] or None,
    )


_PREPARED: dict = {}


def prepared(spark: SparkSession, sf: str, spec: Spec) -> Prepared:
    """The cleaned corpus, profiled once per application."""
    key = (spark.sparkContext.applicationId, sf, spec.source, spec.member)
    if key not in _PREPARED:
        _PREPARED[key] = prepare(corpus(spark, sf, spec))
    return _PREPARED[key]
