"""Queries that read every row of their table, and every column that they are about."""

import duckdb
import pytest


@pytest.fixture
def both(spark, tmp_path):
    """The rows of a query, and of its SQL, over customers (key, nation)."""
    from sparkquarry.plans import QUERIES

    def found(name, customers):
        run, text = QUERIES[name]
        spark.createDataFrame([(*c, 1.0) for c in customers], "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
        con = duckdb.connect()
        con.sql(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
        want = con.sql(text)
        rows = run(spark, str(tmp_path)).select(*want.columns).collect()
        assert sorted(map(tuple, rows)) == sorted(want.fetchall())
        return sorted(map(tuple, rows))

    return found


def test_f1_mail_domains_of_all_leads_and_of_their_own_sites(both):
    assert both("mail_domains", [(0, 0), (1, 1), (4, 4), (5, 1), (9, 1)]) == [
        (0, "maplefoods.example.com"), (1, "careers.blueheronprecastconcreteco.com"), (4, "careers.grandriverplastics.com"), (5, "careers.stclaircoffeeroasters.com"), (9, "careers.crystalsonsplasticsco.com"),
    ]


def test_f2_profile_contacts_without_a_role_of_the_table(both):
    profile = "https://www.linkedin.com/in/p-"
    # Their titles: Operations, title not public, none, Sales Director, Owner, Retired Foreman; the role of 13 has ended.
    assert both("profile_contacts", [(4, 9), (7, 8), (10, 1), (16, 0), (19, 4), (22, 4), (13, 8)]) == [
        (4, "Robert Miller", "Operations - X", f"{profile}4"), (7, "", "", f"{profile}7"), (10, "", "", f"{profile}10"),
        (16, "Jane Stone", "", f"{profile}16"), (19, "Liz O'Hara", "Owner / operator", f"{profile}19"), (22, "", "", f"{profile}22"),
    ]
