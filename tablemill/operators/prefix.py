"""Prefix sums of a large ordered table, by ranges: no task holds a whole order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tablemill.session import stage


def prefix_sums(df: DataFrame, group: list[str], by: list[str], values: list[str]) -> DataFrame:
    """`df` with `<value>_to` for each of `values`: its sum over the group's rows up to and with this one, in the order of `by`.

    `by` must be unique within a group; NULL values are 0. Rows are dealt by ranges of (group, by); sums within
    a range start at what the group's earlier ranges add up to. There is one such number per range, and
    one more for each group that begins inside a range, so the groups have to be few.
    """
    pieces = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = df.withColumns({f"{v}_to": F.coalesce(v, F.lit(0)).cast("bigint") for v in values})
    ranged = stage(counted.repartitionByRange(pieces, *group, *by).withColumn("__range", F.spark_partition_id()))
    whole = ranged.groupBy(*group, "__range").agg(*[F.sum(f"{v}_to").alias(f"__{v}") for v in values])
    before = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    bases = whole.select(*group, "__range", *[F.coalesce(F.sum(f"__{v}").over(before), F.lit(0)).alias(f"__{v}") for v in values])
    upto = Window.partitionBy(*group, "__range").orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = {f"{v}_to": F.col(f"__{v}") + F.sum(f"{v}_to").over(upto) for v in values}
    placed = ranged.join(F.broadcast(bases), [*group, "__range"])
    return placed.withColumns(sums).select(*df.columns, *sums)
