"""Checks of outputs and of the separation between training and held-out tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablemill.constants import FORMATS, PAIR_TYPES
from tablemill.operators.runs import formats_dim


def check_outputs(
    pairs: DataFrame, expected_tables: DataFrame, others: dict[str, DataFrame] | None = None
) -> DataFrame:
    """Per artefact the lines found and expected, and what is wrong (NULL if nothing is).

    Artefacts are the pairs of each format, of which the number is known, and `others` (ground truth,
    completed ids, clean tables), which have to be there.
    """
    per_format = _check_pairs(pairs, expected_tables)
    for name, rows in (others or {}).items():
        n = rows.agg(F.count(F.lit(1)).alias("n_lines"))
        per_format = per_format.unionByName(
            n.select(
                F.lit(name).alias("artefact"),
                "n_lines",
                F.lit(None).cast("bigint").alias("expected_lines"),
                F.when(F.col("n_lines") == 0, "missing or empty").alias("failure"),
            )
        )
    return per_format


def _check_pairs(pairs: DataFrame, expected_tables: DataFrame) -> DataFrame:
    expected = expected_tables.agg((F.count(F.lit(1)) * len(PAIR_TYPES)).alias("expected_lines"))
    found = pairs.groupBy("format").agg(F.count(F.lit(1)).alias("n_lines"))
    n, e = F.coalesce("n_lines", F.lit(0)), F.col("expected_lines")
    return (
        formats_dim(pairs)
        .drop("pos")
        .join(found, "format", "left")
        .crossJoin(F.broadcast(expected))
        .select(
            F.col("format").alias("artefact"),
            n.alias("n_lines"),
            "expected_lines",
            F.when(n == 0, "missing or empty").when(n != e, "wrong number of lines").alias("failure"),
        )
    )


def table_fingerprints(rows: DataFrame) -> DataFrame:
    """A digest of each table's content that does not depend on row order.

    Row digests are added up in four parts of 60 bits or less: sums combine on
    the map side, where sorting digests would gather a whole table in one task.
    """
    digest = F.md5(
        F.array_join(F.transform("cells", lambda c: F.coalesce(c, F.lit("\x1e"))), "\x1f").cast("binary")
    )
    parts = [
        F.sum(
            F.conv(F.substring("digest", start, 8), 16, 10).cast("decimal(30,0)") * F.col("n_copies")
        ).alias(f"d{start}")
        for start in (1, 9, 17, 25)
    ]
    return (
        rows.withColumn("digest", digest)
        .groupBy("chunk", "table_id")
        .agg(F.sum("n_copies").alias("n_rows"), *parts)
        .select(
            "chunk",
            "table_id",
            F.md5(F.concat_ws("-", *[F.col(c).cast("string") for c in ["n_rows", "d1", "d9", "d17", "d25"]]).cast("binary")).alias("fingerprint"),
        )
    )


def holdout_leak(rows: DataFrame, held_out: list[int]) -> DataFrame:
    """Held-out tables whose content also lies in a training chunk."""
    prints = table_fingerprints(rows)
    training = prints.filter(~F.col("chunk").isin(held_out)).select("fingerprint").distinct()
    return (
        prints.filter(F.col("chunk").isin(held_out))
        .join(training, "fingerprint", "left_semi")
        .select("table_id", "fingerprint")
    )
