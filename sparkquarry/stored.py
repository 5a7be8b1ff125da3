"""Steps of long jobs, kept as tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or the one given to setCheckpointDir."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder


def cut(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read back; `free` deletes it.

    What follows starts from files that outlive any executor, and its plan doesn't grow.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.cut_path = path
    return back


def free(*tables: DataFrame) -> None:
    """Delete what `cut` has written, once nothing will read it any more."""
    for df in tables:
        spark = df.sparkSession.sparkContext
        path = spark._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def worked_out(df: DataFrame, **columns: Column) -> DataFrame:
    """`df` plus columns that are worked out in a step of their own: later ones, and filters, read them instead of repeating their expressions."""
    return df.select("*", F.inline(F.array(F.struct(*[x.alias(k) for k, x in columns.items()]))))
