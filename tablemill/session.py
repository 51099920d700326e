"""Session defaults. A cluster's own settings win; these only fill what is unset."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tablemill")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-", dir="/tmp"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`, or a local one if a local run has none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), f"tablemill-{os.getuid()}")
    return folder


def new_folder(spark: SparkSession) -> str:
    """The name of a fresh folder in the shared one."""
    return os.path.join(shared_folder(spark), f"out-{uuid.uuid4().hex}")


def once(df: DataFrame, *columns: Column) -> DataFrame:
    """`df` with `columns` evaluated where they stand.

    The planner merges projections and copies an expression to each of its uses, also into filters; what
    a generator gives isn't copied.
    """
    return df.select(*df.columns, F.inline(F.array(F.struct(*columns))))


def stage(df: DataFrame) -> DataFrame:
    """Write a result that several later steps read; its lineage ends there.

    The table lies in the shared folder, so a lost executor costs no recomputation,
    and its size is known to the planner. The folder is the caller's to clean.
    """
    spark = df.sparkSession
    path = os.path.join(shared_folder(spark), f"stage-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
