"""Every query that has SQL gives the rows of its SQL on the smallest tables."""

import os

import duckdb
import pytest

from sparkquarry.plans import QUERIES
from sparkquarry.streaming.events import daily_counts

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", [n for n, (_, text) in QUERIES.items() if text])
def test_query_equals_sql(spark, sql, name):
    run, text = QUERIES[name]
    found, want = run(spark, SF), sql.sql(text)
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)
    rows = [tuple(str(r[c]) for c in columns) for r in found.collect()]
    at = [want.columns.index(c) for c in columns]
    assert sorted(rows) == sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())
    assert rows


def test_daily_counts_streams_as_in_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").selectExpr("cast(ts as timestamp) ts", "event_type")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = daily_counts(stream).writeStream.outputMode("complete").format("memory").queryName("days").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(spark.table("days").collect()) == sorted(daily_counts(events).collect())


def test_csv_round_trip(spark, tmp_path):
    from sparkquarry.sources.files import read_csv, write_csv

    (tmp_path / "in.csv").write_text('Company Name,,Notes\r\n" A, ""b"" ",x,"two\nlines"\r\n,,\r\nshort\r\n')
    rows = read_csv(spark, str(tmp_path / "in.csv"))
    assert rows.columns == ["company_name", "column_2", "notes"]
    assert [tuple(r) for r in rows.collect()] == [('A, "b"', "x", "two\nlines"), ("short", "", "")]
    write_csv(rows, str(tmp_path / "out"), ("notes",))
    assert sorted(map(tuple, read_csv(spark, str(tmp_path / "out")).select(*rows.columns).collect())) == sorted(map(tuple, rows.collect()))


def test_quota_pick_equals_a_plain_walk(spark):
    from sparkquarry.operators.matching import quota_pick

    from pyspark.sql import functions as F

    rows = [(i, i % 3 if i % 5 else 0, i * 7 % 4, (i * 37) % 101) for i in range(120)]
    caps = {"a": 6, "b": 9}
    found = quota_pick(spark.createDataFrame(rows, "id long, a long, b long, v long"), caps, [F.desc("v"), F.asc("id")], 30).collect()
    taken, n = [], {}
    ordered = sorted(rows, key=lambda x: (-x[3], x[0]))
    for x in ordered:
        if len(taken) < 30 and n.get(("a", x[1]), 0) < 6 and n.get(("b", x[2]), 0) < 9:
            taken.append(x[0])
            for k in (("a", x[1]), ("b", x[2])):
                n[k] = n.get(k, 0) + 1
    fill = [x[0] for x in ordered if x[0] not in taken][: 30 - len(taken)]
    assert fill and sorted((x["id"], x["_fill"]) for x in found) == sorted([(i, False) for i in taken] + [(i, True) for i in fill])


def test_rules(spark):
    from pyspark.sql import functions as F

    from sparkquarry.operators import records, rules

    row = spark.range(1).select(
        records.lead_stage(F.lit(False), F.lit(False)).alias("d"), records.lead_stage(F.lit(True), F.lit(True)).alias("e"), records.lead_stage(F.lit(True), F.lit(False)).alias("f"),
        rules.sweep_score(*map(F.lit, (0, 1, 0)), 2, *map(F.lit, (False, True, False, True))).alias("g"), rules.sweep_score(*map(F.lit, (2, 1, 3)), 2, *map(F.lit, (True,) * 4)).alias("h"),
        rules.personal_addresses(F.lit("Dr. Ann B. O'Hara"), F.lit("www.X.example")).alias("i"), rules.personal_addresses(F.lit("Cher"), F.lit("x.example")).alias("j"), rules.personal_addresses(F.lit(None), F.lit("x")).alias("k"),
    ).first()
    assert row[:3] == ("Plant Verified - Needs Contact + Products", "Ready for Outreach", "Plant Verified - Needs Products")
    assert row[3:5] == (10 + 40 + 40 + 15 + 35 + 20 - 5, 5)
    assert row[5:] == (["ann.ohara@x.example", "annohara@x.example", "aohara@x.example", "ann@x.example", "ohara@x.example"], ["cher@x.example"], [])


def test_jaccard_matches_with_copies_and_empty_sets(spark):
    from sparkquarry.operators.matching import jaccard_matches

    left = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b"]), (3, []), (4, None)], "id long, tokens array<string>")
    right = spark.createDataFrame([(7, ["b", "a"]), (8, ["a", "b", "c"]), (9, ["z"])], "id long, tokens array<string>")
    assert sorted(map(tuple, jaccard_matches(left, right, 0.6).collect())) == [(i, j, s) for i in (1, 2) for j, s in ((7, 1.0), (8, 0.666667))]
