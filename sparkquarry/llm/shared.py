"""Helpers that several corpus operators use."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space that line keys are stripped of and that separates words.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named Parquet table below `sf_dir`, whatever file system that is on."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Only a session on one machine may leave it unset; it then has a folder of that machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder or tempfile.mkdtemp(prefix="spark-")


def give_back() -> None:
    """Return freed memory of a Python worker to the system: workers live on, and the next step's come on top."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU C library
        pass


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within, a finished write gives back its shuffle files at once, not when the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def cut(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read back.

    Later stages then start from files that outlive any executor; `free` deletes them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with _shuffles_freed(spark):
        writer.parquet(path)
    back = spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)
    back.cut_path = path
    return back


def cut_in_buckets(df: DataFrame, name: str, by: str, buckets: int) -> DataFrame:
    """As `cut`, dealt to files by the hash of a column: joins and cogroups by it then leave this table where it is.

    There are as many buckets as shuffle partitions at least, so that Spark moves the other side to them.
    """
    spark = df.sparkSession
    buckets = max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
    table_name = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    path = f"{shared_dir(spark)}/{table_name}"
    with _shuffles_freed(spark):
        df.repartition(buckets, by).write.bucketBy(buckets, by).option("path", path).saveAsTable(table_name)
    back = spark.table(table_name)
    back.cut_path = path
    return back


def free(*tables: DataFrame) -> None:
    """Delete what `cut` has written, once nothing will read it any more."""
    for df in tables:
        spark = df.sparkSession.sparkContext
        path = spark._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(docs: DataFrame, row: str) -> DataFrame:
    """`docs` plus a number of each row that stays the same however often it is read.

    Rows of files are numbered by file and place in it, without a copy; other tables are written
    with their numbers. The file names that this joins are as few as the input's files.
    """
    try:
        own = docs.select(F.struct("*").alias("_row"), F.col("_metadata.file_path").alias("_of"), F.col("_metadata.row_index").alias("_at"))
        files = docs.select(F.col("_metadata.file_path").alias("_path")).distinct()
    except AnalysisException:  # not of files, or of files whose rows have no numbers
        return cut(docs.withColumn(row, F.monotonically_increasing_id()), "numbered-rows")
    by_name = Window.partitionBy(F.lit(0)).orderBy("_path")
    files = cut(files.withColumn("_file", F.row_number().over(by_name)), "files")
    number = F.col("_file").cast("long") * F.lit(1 << 36) + F.col("_at")
    met = own.join(F.broadcast(files), F.col("_of") == F.col("_path"))
    return met.select(*[F.col("_row")[c].alias(c) for c in docs.columns], number.alias(row))


def with_safe_names(stage: Callable[[DataFrame], DataFrame], docs: DataFrame, *known: str) -> DataFrame:
    """What `stage`, which keeps a table's columns, makes of `docs`; it sees columns other than `known` under
    names that clash with nothing."""
    safe = docs.toDF(*[c if c in known else f"other_{i}" for i, c in enumerate(docs.columns)])
    return stage(safe).toDF(*docs.columns)


def ascii_lower(col):
    """A-Z lower-cased; all other letters stay as they are."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that starts with `stem` and that `df` doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    name = f"_{stem}"
    while name.lower() in taken:
        name = f"_{name}"
    return name
