"""The library's own queries over the sample tables, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkquarry.functions import js, names
from sparkquarry.functions import text as t
from sparkquarry.operators import relational as r
from sparkquarry.operators.matching import jaccard_matches

QUERIES: dict[str, tuple] = {}


def _query(sql: str):
    def add(run):
        def named(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[run.__name__] = (named, sql)
        return run

    return add


_STRIP = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))"
_HOST = r"regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:www\.)?([^/:?#]+)', 1)"


@_query(f"SELECT page_id, length(x) AS n_chars, CASE WHEN x = '' THEN 0 ELSE len(string_split(x, ' ')) END AS n_words FROM (SELECT page_id, {_STRIP.format('html')} AS x FROM pages)")
def page_text_stats(table):
    x = t.strip_html("html")
    return table("pages").select("page_id", F.length(x).alias("n_chars"), F.when(x == "", 0).otherwise(F.size(F.split(x, " "))).alias("n_words"))


@_query(
    f"SELECT page_id, {_STRIP.format(chr(40) + 'regexp_extract(html, ' + chr(39) + '(?is)<title[^>]*>(.*?)</title>' + chr(39) + ', 1))')} AS title, "
    f"{_STRIP.format(chr(40) + 'regexp_extract(html, ' + chr(39) + '(?is)<h1[^>]*>(.*?)</h1>' + chr(39) + ', 1))')} AS h1 FROM pages"
)
def page_fields(table):
    return table("pages").select("page_id", t.html_field("html", "title").alias("title"), t.html_field("html", "h1").alias("h1"))


@_query(f"SELECT site, count(*) AS n_pages, min(page_id) AS first_page, min_by(url, page_id) AS first_url FROM (SELECT *, CASE WHEN {_HOST} = '' THEN '' ELSE 'site://' || {_HOST} END AS site FROM pages) GROUP BY site")
def site_profile(table):
    pages = table("pages").withColumn("site", t.site_key("url"))
    return pages.groupBy("site").agg(F.count("*").alias("n_pages"), F.min("page_id").alias("first_page"), F.min_by("url", "page_id").alias("first_url"))


@_query(r"SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS canonical FROM pages")
def page_urls(table):
    return table("pages").select("page_id", t.canonical_url("url").alias("canonical"))


@_query(r"""SELECT doc_id, len(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}'))) AS n_emails,
  len(regexp_extract_all(coalesce(text, ''), '\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}')) AS n_phones FROM documents""")
def doc_entities(table):
    return table("documents").select("doc_id", F.size(t.emails("text")).cast("long").alias("n_emails"), F.size(t.phones("text")).cast("long").alias("n_phones"))


_NAME = f"trim({js.sql_sub(js.sql_sub(js.sql_sub('lower({0})', '&', ' and '), chr(92) + 'b(?:ltd|limited|inc|incorporated|corp|corporation|co|company|llc|lp|plc)' + chr(92) + 'b', ' '), '[^a-z0-9]+', ' ')})"


@_query(f"SELECT p_partkey, {_NAME.format('p_name')} AS name_key FROM part")
def name_keys(table):
    return table("part").select("p_partkey", names.dedupe_name("p_name").alias("name_key"))


@_query("SELECT source, min(doc_id) AS doc_id, min_by(lang, doc_id) AS lang FROM documents GROUP BY source")
def first_per_source(table):
    return r.first_value_per_key(table("documents"), ["source"], F.col("doc_id"), ["doc_id", "lang"])


@_query("""WITH s AS (SELECT item_id, list_filter(list_distinct(regexp_split_to_array(lower(text), '[^a-z]+')), lambda x: length(x) >= 2) AS w FROM benchmark),
p AS (SELECT item_id, len(w) AS n, unnest(w) AS k FROM s)
SELECT a.item_id AS left_id, b.item_id AS right_id, round(count(*) / (any_value(a.n) + any_value(b.n) - count(*)), 6) AS similarity
FROM p a JOIN p b ON a.k = b.k AND a.item_id < b.item_id GROUP BY 1, 2 HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.2""")
def token_jaccard_pairs(table):
    items = table("benchmark").select(F.col("item_id").alias("id"), t.tokens("text").alias("tokens"))
    return jaccard_matches(items, items, 0.2).where("left_id < right_id")


@_query("""SELECT c_custkey, k IN (SELECT regexp_extract(s_name, '([0-9]+)', 1) FROM supplier) AS name_bit, c_nationkey IN (SELECT s_nationkey FROM supplier) AS nation_bit
FROM (SELECT *, regexp_extract(c_name, '([0-9]+)', 1) AS k FROM customer)""")
def dup_bits(table):
    known = table("supplier").select(F.regexp_extract("s_name", "([0-9]+)", 1).alias("name"), F.col("s_nationkey").alias("nation"))
    rows = table("customer").select("c_custkey", F.regexp_extract("c_name", "([0-9]+)", 1).alias("name"), F.col("c_nationkey").alias("nation"))
    return r.membership(rows, known, {"name": "name_bit", "nation": "nation_bit"}).select("c_custkey", "name_bit", "nation_bit")


@_query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def top_per_key(table):
    best = r.first_per_key(table("orders"), ["o_custkey"], F.desc("o_totalprice"), F.asc("o_orderkey"))
    return best.select("o_custkey", "o_orderkey", "o_totalprice")


@_query("SELECT user_id, event_id, event_type FROM (SELECT *, min(event_type) OVER (PARTITION BY user_id) AS lowest FROM events) WHERE event_type = lowest")
def provider_fallback(table):
    """The events of each user's first provider that has any; its name is found by a partial aggregate, not by a window over all rows."""
    lowest = table("events").groupBy(F.col("user_id").alias("_user")).agg(F.min("event_type").alias("lowest"))
    found = table("events").join(lowest, (F.col("user_id") == F.col("_user")) & (F.col("event_type") == F.col("lowest")))
    return found.select("user_id", "event_id", "event_type")


@_query("SELECT user_id, event_id FROM (SELECT *, coalesce(sum(1) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM events) WHERE b < 3")
def early_stop_batches(table):
    return r.until_enough(table("events"), ["user_id"], [F.asc("event_id")], F.lit(1), 3).select("user_id", "event_id")


@_query("SELECT c_custkey, count(o_orderkey) AS n_orders, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_finished FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def group_children(table):
    counts = table("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    joined = table("customer").join(counts, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.coalesce("f", F.lit(0)).alias("n_finished"))


@_query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%') AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey)")
def anti_contacted(table):
    urgent = table("orders").where("o_orderpriority LIKE '1%'")
    left = table("customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return left.join(table("supplier"), F.col("c_custkey") == F.col("s_suppkey"), "left_anti").select("c_custkey")


@_query("SELECT c_custkey, coalesce(strftime(max(o_orderdate), '%Y-%m-%d'), '') AS latest FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def latest_activity(table):
    last = table("orders").groupBy("o_custkey").agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("d"))
    return table("customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("d", F.lit("")).alias("latest"))


@_query("""WITH last AS (SELECT c_custkey, c_nationkey, c_mktsegment, coalesce(strftime(max(o_orderdate), '%Y-%m-%d'), '') AS latest
  FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL)
SELECT c_custkey, n_name, latest FROM last JOIN nation ON c_nationkey = n_nationkey WHERE latest < '2001-01-01'
QUALIFY row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY latest, c_custkey) <= 3""")
def campaign_plan(table):
    """Customers without activity since a day, three of each segment and nation, the longest idle first."""
    last = table("orders").groupBy("o_custkey").agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("d"))
    idle = table("customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").withColumn("latest", F.coalesce("d", F.lit(""))).where("latest < '2001-01-01'")
    row = F.row_number().over(W.partitionBy("c_mktsegment", "c_nationkey").orderBy("latest", "c_custkey"))
    best = idle.withColumn("_row", row).where("_row <= 3")
    return best.join(table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "latest")


@_query("SELECT user_id, min(event_id) AS first_event, max(event_id) AS last_event, count(*) AS times_seen, max_by(nullif(event_type, ''), event_id) AS last_type FROM events GROUP BY user_id")
def skip_cache_merge(table):
    return table("events").groupBy("user_id").agg(
        F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"), F.count("*").alias("times_seen"),
        r.latest_non_empty("event_type", F.col("event_id")).alias("last_type"),
    )


@_query("SELECT coalesce(nullif(trim(o_orderstatus), ''), 'Unknown') AS stage, count(*) AS n FROM orders GROUP BY 1")
def stage_counts(table):
    stage = F.coalesce(F.nullif(F.btrim("o_orderstatus"), F.lit("")), F.lit("Unknown"))
    return table("orders").groupBy(stage.alias("stage")).agg(F.count("*").alias("n"))


@_query("SELECT event_type, max(event_id) AS event_id, max_by(props, event_id) AS props FROM events GROUP BY event_type")
def command_latest(table):
    return table("events").groupBy("event_type").agg(F.max("event_id").alias("event_id"), F.max_by("props", "event_id").alias("props"))


@_query("SELECT user_id, event_id, gap FROM (SELECT user_id, event_id, epoch_us(ts) // 1000000 - lag(epoch_us(ts) // 1000000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) WHERE gap > 86400")
def inactivity_gaps(table):
    """Events that come more than a day after the user's last one, by whole seconds of their times (fractions are cut, not rounded)."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    second = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return table("events").withColumn("gap", second - F.lag(second).over(order)).where("gap > 86400").select("user_id", "event_id", "gap")


@_query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(*) < 30 AS may_send FROM events WHERE event_type = 'purchase' GROUP BY 1")
def daily_quota(table):
    sent = table("events").where("event_type = 'purchase'").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    return sent.withColumn("may_send", F.col("n") < 30)


@_query("SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 20 ELSE 0 END + CASE WHEN c_mktsegment = 'MACHINERY' THEN 15 ELSE 0 END + CASE WHEN n >= 10 THEN 10 WHEN n > 0 THEN 5 ELSE 0 END AS score FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def target_scores(table):
    n = table("orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    rich, machines = F.when(F.col("c_acctbal") > 5000, 20).otherwise(0), F.when(F.col("c_mktsegment") == "MACHINERY", 15).otherwise(0)
    busy = F.when(F.col("n") >= 10, 10).when(F.col("n") > 0, 5).otherwise(0)
    return table("customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", (rich + machines + busy).alias("score"))


@_query("SELECT c_custkey, CASE WHEN n > 0 AND c_acctbal > 0 THEN 'ready' WHEN n > 0 THEN 'needs contact' ELSE 'needs products' END AS stage, concat_ws(' | ', CASE WHEN n > 0 THEN 'has-orders' END, lower(c_mktsegment)) AS tags FROM (SELECT c_custkey, c_acctbal, c_mktsegment, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL)")
def lead_stage_tags(table):
    n = table("orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    rows = table("customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left")
    stage = F.when((F.col("n") > 0) & (F.col("c_acctbal") > 0), "ready").when(F.col("n") > 0, "needs contact").otherwise("needs products")
    return rows.select("c_custkey", stage.alias("stage"), F.concat_ws(" | ", F.when(F.col("n") > 0, "has-orders"), F.lower("c_mktsegment")).alias("tags"))
