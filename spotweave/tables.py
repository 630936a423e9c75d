"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of applications that name none.
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a new temporary folder in local mode, else an error.

    A folder of one machine's own would be lost with it, and other executors couldn't read it.
    """
    app = spark.sparkContext.applicationId
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if app not in _own:
        own = spark.sparkContext.getCheckpointDir()
        if not own and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own[app] = own or tempfile.mkdtemp(prefix="spotweave-")
    return _own[app]


def written(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again: computed once, safe against lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/spotweave-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that `written` made, of which all that was read is written."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def settled(table: DataFrame) -> DataFrame:
    """A written table, after Spark was told to remove the shuffle files behind it: else they stay until the driver happens to collect its garbage.

    Those of the very last write may stay until the next call.
    """
    table.sparkSession.sparkContext._jvm.System.gc()
    return table
