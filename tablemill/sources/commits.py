"""Batches of files that appear together or not at all.

A sink writes each batch into a folder of its own, `<path>/batch=<name>`, replacing what an earlier attempt at the
batch left there. A batch counts once its name stands in the log, which is written after all its sinks; readers
take committed batches only. So a job that stops between two sinks leaves nothing that is read, and one that
repeats a batch, committed or not, adds nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: The column that a batch's folder adds.
BATCH = "batch"


def _hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def path_exists(spark: SparkSession, path: str) -> bool:
    store, where = _hadoop(spark, path)
    return store.exists(where)


def folder_of(path: str, batch: str) -> str:
    return f"{path}/{BATCH}={batch}"


def write_batch(df: DataFrame, path: str, batch: str, form: str = "json", by: tuple[str, ...] = ()) -> None:
    """A batch's files of one sink; they count once the batch is committed."""
    df.write.partitionBy(*by).mode("overwrite").format(form).save(folder_of(path, batch))


def commit(spark: SparkSession, log: str, batch: str) -> None:
    """Make a batch count: an empty file of its name, which is there or isn't. Committing again changes nothing."""
    store, where = _hadoop(spark, f"{log}/{batch}")
    store.create(where, True).close()


def committed(spark: SparkSession, log: str) -> list[str]:
    """Names of the committed batches, in order."""
    store, where = _hadoop(spark, log)
    if not store.exists(where):
        return []
    return sorted(s.getPath().getName() for s in store.listStatus(where) if s.isFile())


def read_batches(spark: SparkSession, path: str, log: str, schema: str, form: str = "json") -> DataFrame:
    """The committed rows of a sink, and the name of their batch."""
    folders = [folder_of(path, b) for b in committed(spark, log)]
    folders = [f for f in folders if path_exists(spark, f)]
    schema = f"{schema}, {BATCH} string"
    if not folders:
        return spark.createDataFrame([], schema)
    found = spark.read.schema(schema).option("basePath", path).format(form).load(folders)
    return found.select(StructType.fromDDL(schema).fieldNames())
