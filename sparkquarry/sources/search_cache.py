"""A cache of searches as a table of files: what it lacks is searched for, and what is found is written back.

A write adds a folder of its own and never changes one. A folder counts once Spark's job commit
has left its mark there, so a write that failed half way is as if it had never been. Of several
entries for one query the newest counts, which makes a later write an update. `compact` puts the
entries that still live into one folder and deletes the others.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkquarry.functions import js
from sparkquarry.sources.files import CACHE_SCHEMA

DAY_MS = 86_400_000
#: In which order the engines' results are put together.
ENGINES = ("bing", "yahoo", "duckduckgo")
MOST = 12  # results that an entry keeps


def _folders(spark: SparkSession, path: str) -> list[str]:
    """The committed writes of a cache, oldest name first; a cache that isn't there has none."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return []
    found = [s.getPath() for s in fs.listStatus(root) if s.isDirectory()]
    return sorted(p.toString() for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def entries(spark: SparkSession, path: str) -> DataFrame:
    """(createdAt, query, results) of every query's newest entry."""
    folders = _folders(spark, path)
    if not folders:
        return spark.createDataFrame([], CACHE_SCHEMA)
    every = spark.read.schema(CACHE_SCHEMA).parquet(*folders)
    return every.groupBy("query").agg(F.max_by(F.struct("createdAt", "results"), "createdAt").alias("e")).select("e.createdAt", "query", "e.results")


def live(spark: SparkSession, path: str, now_ms: int, days: int = 7) -> DataFrame:
    """The entries younger than `days`."""
    return entries(spark, path).where(F.lit(now_ms) - F.col("createdAt") < days * DAY_MS)


def write_back(found: DataFrame, path: str) -> None:
    """Add entries (createdAt, query, results); they take the place of older ones of their queries."""
    found.select("createdAt", "query", "results").write.parquet(f"{path.rstrip('/')}/write-{uuid.uuid4().hex}")


def compact(spark: SparkSession, path: str, now_ms: int, days: int = 7) -> None:
    """One folder of the live entries instead of all there are; a reader meanwhile may see both, which changes nothing."""
    before = _folders(spark, path)
    write_back(live(spark, path, now_ms, days), path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in before:
        at = jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(conf).delete(at, True)


def merged_results(hits: DataFrame) -> DataFrame:
    """(query, results) of `hits` (query, engine, pos, title, url, snippet): engines in their order, addresses without
    query and fragment each once, 12 at most. Hits without address don't count; engines of no known name come last."""
    order = F.coalesce(F.array_position(F.array(*[F.lit(e) for e in ENGINES]), F.col("engine")), F.lit(0))
    place = F.struct(F.when(order == 0, len(ENGINES) + 1).otherwise(order).alias("engine"), F.col("pos"))
    keyed = hits.select("query", place.alias("place"), js.sub(js.clean("url"), r"[?#].*$", "").alias("key"), F.struct("title", "url", "snippet").alias("hit")).where("key <> ''")
    once = keyed.groupBy("query", "key").agg(F.min_by("hit", "place").alias("hit"), F.min("place").alias("place"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("place", "key"))
    few = once.withColumn("rank", rank).where(F.col("rank") <= MOST)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "hit"))), lambda x: x["hit"])
    return few.groupBy("query").agg(listed.alias("results"))


def searched(queries: DataFrame, path: str, search: Callable[[DataFrame], DataFrame], now_ms: int, days: int = 7) -> DataFrame:
    """(query, results, cached) of each of `queries` (query), from the cache at `path` or else by `search`, which
    makes hits (see merged_results) of the queries that the cache lacks; these are written back, empty ones too."""
    spark = queries.sparkSession
    wanted = queries.where("query IS NOT NULL").select("query").distinct()
    # The live entries as they are now: what is written back below mustn't count as known before.
    known = live(spark, path, now_ms, days).select("query", "results")
    missing = wanted.join(known, "query", "left_anti")
    found = missing.join(merged_results(search(missing)), "query", "left").select(F.lit(now_ms).cast("long").alias("createdAt"), "query", F.coalesce("results", F.array().cast(known.schema["results"].dataType)).alias("results"))
    fresh = f"{path.rstrip('/')}/write-{uuid.uuid4().hex}"
    found.write.parquet(fresh)
    made = spark.read.schema(CACHE_SCHEMA).parquet(fresh).select("query", "results")
    return wanted.join(known, "query").select("query", "results", F.lit(True).alias("cached")).unionByName(made.withColumn("cached", F.lit(False)))
