"""Work that must not grow with the square of equal rows, nor repeat what is worked out once; times at the edge of a second."""

import time

import duckdb
from pyspark.sql import functions as F


def test_gaps_cut_fractions_of_seconds(spark, tmp_path):
    from sparkquarry.plans import QUERIES

    run, text = QUERIES["inactivity_gaps"]
    times = ("2024-01-01 00:00:00.999600", "2024-01-02 00:00:01.000000", "2024-01-03 00:00:02.999700")
    rows = spark.createDataFrame([(i, 1, t) for i, t in enumerate(times)], "event_id long, user_id long, ts string").withColumn("ts", F.expr("cast(ts AS timestamp_ntz)"))
    rows.write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    found = run(spark, str(tmp_path)).select("user_id", "event_id", "gap").collect()
    assert sorted(map(tuple, found)) == sorted(con.sql(text).fetchall()) == [(1, 1, 86401), (1, 2, 86401)]


def test_equal_contacts_meet_no_pairs(spark):
    from sparkquarry.functions.contacts import is_weak_title
    from sparkquarry.operators.greedy import first_existing

    rows = spark.range(120_000).select(F.col("id").alias("pos"), F.lit(1).alias("group"), F.lit("jane doe").alias("name"), F.when(F.col("id") % 4 == 3, "").otherwise("owner").alias("title"), F.lit("l").alias("link"))
    began = time.time()
    found = first_existing(rows.where("pos % 2 = 0"), rows.where("pos % 2 = 1"), is_weak_title)
    assert found.agg(F.count("*"), F.min("existing_pos"), F.max("existing_pos")).first() == (60_000, 1, 1)
    assert time.time() - began < 60


def test_equal_names_are_looked_up_once(spark):
    from sparkquarry.operators.greedy import looked_up

    rows = spark.range(120_000).select("id", F.lit("Maple Foods Ltd").alias("company"))
    began = time.time()
    found = looked_up(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"))
    assert found.agg(F.count("*"), F.min("known_id"), F.max("known_id")).first() == (60_000, 1, 1)
    assert time.time() - began < 60


def test_values_are_worked_out_once(spark):
    from sparkquarry.functions import pages, search
    from sparkquarry.sources import files

    size = lambda column: len(str(column))
    assert size(search.mail_domain(F.col("w"), F.col("t"))) < 6_000
    assert size(pages.addresses(F.col("t"))) < 8_000
    assert size(files.directory_profile(F.col("h"), F.col("s"))) < 18_000
    assert all(size(search.results(F.col("h"), d)) < 10_000 for d in search.DIALECTS)


def test_sample_rows_are_dealt(spark, tmp_path):
    from sparkquarry.plans.samples import sample

    spark.range(50).selectExpr("id AS c_custkey", "cast(id % 25 AS int) AS c_nationkey", "1.0D AS c_acctbal").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    leads = sample(lambda name: spark.read.parquet(f"{tmp_path}/{name}.parquet"), "leads").where("length(company) > 3")
    assert leads.select(F.spark_partition_id().alias("p")).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_mentions_of_equal_companies_are_counted_without_pairs(spark):
    from sparkquarry.operators.context import context_counts

    results = spark.range(60_000).select(F.col("id").alias("result"), F.lit("Maple Foods news").alias("title"), F.when(F.col("id") == 7, "Jane Doe Group").otherwise("").alias("snippet"))
    hints = F.when(F.col("id") == 5, F.array(F.lit("Jane Doe Group"))).otherwise(F.array(F.lit("Maple Foods")))
    companies = spark.range(60_000).select(F.col("id").alias("company"), hints.alias("hints"))
    began = time.time()
    found = context_counts(results, companies, "signal")
    assert sorted(map(tuple, found.groupBy("companies", "company").count().collect())) == [(59_999, 0, 59_999), (60_000, 0, 1)]
    assert time.time() - began < 60


def test_results_of_a_group_are_not_compared_with_all_its_names(spark):
    from sparkquarry.operators.context import repaired_contacts

    size = 20_000
    named = F.format_string("Nr%05d%05d Works", F.col("id"), (F.col("id") * 7919) % 99991)
    results = spark.range(size).select(
        F.lit(1).alias("group"), F.col("id").alias("pos"), F.concat(F.lit("Jane Doe - Plant Manager - "), F.when(F.col("id") == size - 1, named).otherwise("None")).alias("title"), F.col("id").cast("string").alias("snippet"), F.lit("").alias("url")
    )
    people = spark.sql("SELECT 1 AS group, 1 AS pos, 'Jane Doe' AS name, '' AS link, '' AS source, '' AS notes, '' AS title")
    companies = spark.range(size).groupBy(F.lit(1).alias("group")).agg(F.collect_list(named).alias("hints"))
    began = time.time()
    assert [(r["result"], r["title"]) for r in repaired_contacts(results, people, companies).collect()] == [(size - 1, "Plant Manager")]
    assert time.time() - began < 60
