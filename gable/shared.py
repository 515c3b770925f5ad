"""The folder that driver and executors share, and the tables that are written there between stages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables that write_table has written, by application.
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only on a local master that has none configured."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gable-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it again. Lost executors can't lose it. `remove_tables` removes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gable/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_tables(spark: SparkSession) -> int:
    """Remove the tables that operators have written in this application, and return how many there were.

    Results of operators read them lazily, so call this when those have been read or stored.
    """
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)
    return len(paths)
