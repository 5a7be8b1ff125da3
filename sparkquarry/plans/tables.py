"""Queries that write tables to files and read them back; each with SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sparkquarry.plans.catalogue import _query
from sparkquarry.plans.samples import sample, sql
from sparkquarry.sources import files, search_cache
from sparkquarry.stored import shared_dir


@_query("SELECT CAST(doc_id AS VARCHAR) AS id, coalesce(source, '') AS source, length(coalesce(text, '')) AS chars, md5(coalesce(text, '')) AS digest FROM documents")
def csv_round_trip(table):
    """Documents, with their quotation marks, commas and line ends, as CSV and back."""
    docs = table("documents").select(F.col("doc_id").cast("string").alias("ID"), "source", F.col("text").alias("the text"))
    path = f"{shared_dir(docs.sparkSession)}/csv-{uuid.uuid4().hex}"
    files.write_csv(docs, path, first=("source",))
    back = files.read_csv(docs.sparkSession, path, "registry")
    return back.select(F.col("ID").alias("id"), "source", F.length("the text").alias("chars"), F.md5(F.col("the text")).alias("digest"))


_KEY = "'https://x.example/' || (id % 17)"


@_query(f"""WITH h AS (SELECT company AS query, CASE id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 3 END AS engine, id, {_KEY} AS url FROM {sql('leads')}),
r AS (SELECT query, url, row_number() OVER (PARTITION BY query ORDER BY engine, id) AS place FROM h QUALIFY row_number() OVER (PARTITION BY query, url ORDER BY engine, id) = 1)
SELECT query, count(*) AS results, string_agg(url, ' ' ORDER BY place) AS urls, NOT (length(query) % 2 = 0) AS cached FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY place) AS n FROM r) WHERE n <= 12 GROUP BY query""")
def cached_searches(table):
    """Searches for every company, half of which an earlier run has left in the cache."""
    leads = sample(table, "leads")
    spark = leads.sparkSession
    path = f"{shared_dir(spark)}/cache-{uuid.uuid4().hex}"
    engine = F.when(F.col("id") % 3 == 0, "yahoo").when(F.col("id") % 3 == 1, "bing").otherwise("duckduckgo")
    url = F.concat(F.lit("https://x.example/"), (F.col("id") % 17).cast("string"), F.when(F.col("id") % 2 == 0, "?a=b").otherwise(""))
    hits = leads.select(F.col("company").alias("query"), engine.alias("engine"), F.col("id").alias("pos"), F.lit("").alias("title"), url.alias("url"), F.lit("").alias("snippet"))
    queries, day = leads.select(F.col("company").alias("query")).distinct(), search_cache.DAY_MS
    search = lambda missing: hits.join(missing, "query", "left_semi")
    search_cache.searched(queries.where(F.length("query") % 2 == 1), path, search, 100 * day)
    found = search_cache.searched(queries, path, search, 101 * day)
    urls = F.transform("results", lambda r: F.regexp_replace(r["url"], r"\?.*", ""))
    return found.select("query", F.size("results").alias("results"), F.array_join(urls, " ").alias("urls"), "cached")
