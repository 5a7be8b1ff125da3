"""Queries on lead rules, matching, line windows and run logs, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkquarry.functions import js, names
from sparkquarry.functions import lines as ln
from sparkquarry.functions import values as v
from sparkquarry.functions import text as t
from sparkquarry.operators import gates as g
from sparkquarry.operators import matching as m
from sparkquarry.operators import relational as r
from sparkquarry.operators import rules
from sparkquarry.plans.catalogue import _HOST, _NAME, _STRIP, _query

#: Where a site's links lead, the most telling first; others come last.
HINTS = ("about", "product", "contact", "team", "the", "and")
_HINT_SQL = " ".join(f"WHEN contains(lower(link), '{h}') THEN {i}" for i, h in enumerate(HINTS))


@_query(f"""WITH l AS (SELECT page_id, unnest(l) AS link, generate_subscripts(l, 1) AS pos FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages)),
d AS (SELECT page_id, link, min(pos) AS pos FROM l GROUP BY ALL)
SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY CASE {_HINT_SQL} ELSE {len(HINTS)} END, pos) AS place FROM d""")
def page_links_ranked(table):
    links = F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('href="([^"]*)"'), F.lit(1)))
    hint = lambda x: F.coalesce(*[F.when(F.contains(F.lower(x), F.lit(h)), i) for i, h in enumerate(HINTS)], F.lit(len(HINTS)))
    ranked = F.array_sort(F.transform(links, lambda x, i: F.struct(hint(x).alias("hint"), i.alias("pos"), x.alias("link"))))
    return table("pages").select("page_id", F.posexplode(ranked)).select("page_id", "col.link", (F.col("pos") + 1).cast("long").alias("place"))


@_query(f"""SELECT doc_id, coalesce(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{{2,}}')[1], '') AS email,
  right(regexp_replace(coalesce(regexp_extract_all(coalesce(text, ''), '\\(?[0-9]{{3}}\\)?[ .-][0-9]{{3}}[ .-][0-9]{{4}}')[1], ''), '[^0-9]', '', 'g'), 10) AS phone,
  {_NAME.format("string_split(coalesce(text, ''), chr(10))[1]")} AS name_key FROM documents""")
def doc_keys(table):
    first = lambda found: F.coalesce(F.get(found, 0), F.lit(""))
    return table("documents").select("doc_id", first(t.emails("text")).alias("email"), t.phone_key(first(t.phones("text"))).alias("phone"), names.dedupe_name(F.get(ln.lines(F.col("text")), 0)).alias("name_key"))


@_query("""WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
s AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS start FROM l), w AS (SELECT *, unnest(range(1, least(3, len(l) - start + 1) + 1)) AS width FROM s)
SELECT doc_id, start, width, md5(array_to_string(l[start:start + width - 1], ' ')) AS span FROM w""")
def doc_line_windows(table):
    spans = table("documents").select("doc_id", F.explode(ln.line_spans(F.col("text"))).alias("s"))
    return spans.select("doc_id", F.col("s.start").cast("long").alias("start"), F.col("s.width").cast("long").alias("width"), F.md5("s.text").alias("span"))


@_query("""WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), s AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS line FROM l)
SELECT doc_id, line, (SELECT count(*) FROM s b WHERE b.doc_id = a.doc_id AND b.line BETWEEN a.line + 1 AND a.line + 8 AND b.line < coalesce(
  (SELECT min(c.line) FROM s c WHERE c.doc_id = a.doc_id AND c.line > a.line AND c.line <= a.line + 8 AND length(c.x) < 30), 1e9)) AS taken
FROM s a WHERE length(x) BETWEEN 1 AND 29""")
def section_lookahead(table):
    """Short lines head sections; the next short or empty line ends them."""
    heads = ln.lines_after(F.col("text"), lambda x: F.length(x).between(1, 29), lambda x: F.length(x) < 30)
    found = table("documents").select("doc_id", F.explode(heads).alias("h"))
    return found.select("doc_id", F.col("h.line").cast("long").alias("line"), F.col("h.taken").cast("long").alias("taken"))


@_query("""WITH reg AS (SELECT min(p_partkey) AS id, lower(p_name) AS key FROM part GROUP BY 2),
c AS (SELECT p_partkey AS id, lower(CASE WHEN p_size > 25 THEN p_name ELSE p_type || ' ' || p_name END) AS key FROM part),
e AS (SELECT c.id AS row_id, reg.id AS registry_id, 1.0::DOUBLE AS similarity FROM c JOIN reg USING (key)),
x AS (SELECT id, list_filter(list_distinct(regexp_split_to_array(key, '[^a-z]+')), lambda x: length(x) >= 2) AS w FROM c WHERE key NOT IN (SELECT key FROM reg)),
y AS (SELECT id, list_filter(list_distinct(regexp_split_to_array(key, '[^a-z]+')), lambda x: length(x) >= 2) AS w FROM reg),
f AS (SELECT x.id AS row_id, y.id AS registry_id, round(len(list_intersect(x.w, y.w)) / (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w))), 6) AS similarity FROM x, y)
SELECT * FROM e UNION ALL SELECT * FROM f WHERE similarity >= 0.6 QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY similarity DESC, registry_id) <= 3""")
def registry_match(table):
    part = table("part")
    key = F.lower(F.when(F.col("p_size") > 25, F.col("p_name")).otherwise(F.concat_ws(" ", "p_type", "p_name")))
    rows = part.select(F.col("p_partkey").alias("id"), key.alias("key"))
    registry = part.groupBy(F.lower("p_name").alias("key")).agg(F.min("p_partkey").alias("id"))
    return m.registry_match(*[x.select("id", "key", t.tokens("key").alias("tokens")) for x in (rows, registry)], 0.6, 3)


@_query("""SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS n_seen, count(*) FILTER (WHERE event_type = 'error') AS n_skipped, count(*) FILTER (WHERE event_type = 'purchase') AS n_added,
  max_by(event_type, event_id) AS last_type, (SELECT event_type FROM (SELECT event_type, count(*) AS n, min(event_id) AS f FROM events b WHERE b.user_id = a.user_id GROUP BY 1) ORDER BY n DESC, f LIMIT 1) AS top_type
FROM events a GROUP BY user_id""")
def log_fold(table):
    """Counters, the last and the most frequent type (of equals, the one seen first) of every run."""
    each = table("events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))
    n = lambda kind: F.coalesce(F.sum(F.when(F.col("event_type") == kind, F.col("n"))), F.lit(0))
    top = F.max_by("event_type", F.struct(F.col("n"), -F.col("first")))
    return each.groupBy("user_id").agg(n("view").alias("n_seen"), n("error").alias("n_skipped"), n("purchase").alias("n_added"), F.max_by("event_type", "last").alias("last_type"), top.alias("top_type"))


_SAID = "coalesce(text, '')"
_SIGNAL_SQL = f"""CASE WHEN {js.sql_test(_SAID, v.SIGNAL_HIRING)} AND {js.sql_test(_SAID, '|'.join(p for _, p in v.SIGNAL_ROLES))} THEN 'Hiring' WHEN NOT {js.sql_test(_SAID, v.SIGNAL_GROWTH)} THEN 'none'
  WHEN {js.sql_test(_SAID, v.SIGNAL_PERMIT)} THEN 'Permit' WHEN {js.sql_test(_SAID, v.SIGNAL_CAPACITY)} THEN 'Capacity' WHEN {js.sql_test(_SAID, v.SIGNAL_PLANNED)} THEN 'Planned expansion' ELSE 'Expansion' END"""
_SIGNAL_OUT = f"""({js.sql_test(_SAID, v.SIGNAL_NEGATIVE)} OR (({js.sql_test(_SAID, v.SIGNAL_OTHER_ROLE)} OR label = 'Hiring') AND NOT {js.sql_test(_SAID, v.SIGNAL_ROLE)})
  OR ({js.sql_test(_SAID, v.SIGNAL_OLD_YEAR)} AND NOT {js.sql_test(_SAID, v.SIGNAL_NEW_YEAR)} AND NOT {js.sql_test(_SAID, v.SIGNAL_CURRENT)}))"""


@_query(f"SELECT source, CASE WHEN {_SIGNAL_OUT} THEN 'none' ELSE label END AS signal, count(*) AS n FROM (SELECT *, {_SIGNAL_SQL} AS label FROM documents) GROUP BY ALL")
def signal_classes(table):
    """Documents of each source by the signal that they would be taken for, of whatever company."""
    found = g.signal(F.lit(""), F.col("text"), F.lit("https://x.example/"), F.lit(True), F.lit(True))
    label = F.coalesce(found["type"], F.lit("none"))
    return table("documents").groupBy("source", label.alias("signal")).agg(F.count("*").alias("n"))


PRESETS = [("bolt", "Fasteners"), ("widget", "Machinery"), ("cold", "Cold storage"), ("steel", "Metals")]
_LABEL_SQL = " ".join(f"WHEN contains(lower(p_name), '{w}') THEN '{x}'" for w, x in PRESETS)


@_query(f"SELECT p_partkey, CASE {_LABEL_SQL} ELSE 'Other' END AS label FROM part")
def industry_label(table):
    return table("part").select("p_partkey", rules.first_label(F.col("p_name"), PRESETS, "Other").alias("label"))


@_query(f"""SELECT quality = 1 AS expected, reason, count(*) AS n FROM (SELECT quality, CASE WHEN NOT coalesce(n_chars > 200, false) THEN {js.quoted(v.GATE_REASONS[0])} WHEN NOT coalesce(toxic = 0, false) THEN {js.quoted(v.GATE_REASONS[1])}
  WHEN coalesce(lang, '') = '' THEN {js.quoted(v.GATE_REASONS[5])} ELSE '' END AS reason FROM documents JOIN labels USING (doc_id)) GROUP BY ALL""")
def gate_confusion(table):
    """What the gates decide of documents, by tests that stand in for theirs, against the expected answer."""
    yes = F.lit(True)
    joined = table("documents").select("doc_id", "n_chars", "lang").join(table("labels"), "doc_id")
    reason = g.default_reason(F.col("n_chars") > 200, F.col("toxic") == 0, yes, yes, yes, F.coalesce("lang", F.lit("")) != "")
    return joined.groupBy((F.col("quality") == 1).alias("expected"), reason.alias("reason")).agg(F.count("*").alias("n"))


@_query("""SELECT 'facility' AS record_type, s_name AS company, '' AS name, n_name AS city FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 'contact', s_name, 'Clerk of ' || s_name, '' FROM supplier WHERE s_acctbal > 0""")
def record_flatten(table):
    """A row for every facility and one for every contact below it."""
    facility = table("supplier").join(table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    empty = F.lit("")
    rows = facility.select(F.lit("facility").alias("record_type"), F.col("s_name").alias("company"), empty.alias("name"), F.col("n_name").alias("city"))
    contact = table("supplier").where("s_acctbal > 0")
    return rows.unionByName(contact.select(F.lit("contact").alias("record_type"), F.col("s_name").alias("company"), F.concat(F.lit("Clerk of "), "s_name").alias("name"), empty.alias("city")))


@_query("""SELECT n_name || ' ' || r_name AS place, unnest(['manufacturer in ', 'plant near ', 'supplier in ']) || n_name || ' ' || r_name AS query FROM nation JOIN region ON n_regionkey = r_regionkey""")
def query_strings(table):
    place = F.concat_ws(" ", "n_name", "r_name")
    forms = F.array(*[F.concat(F.lit(form), place) for form in ("manufacturer in ", "plant near ", "supplier in ")])
    return table("nation").join(table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(place.alias("place"), F.explode(forms).alias("query"))


_TITLE_SQL = _STRIP.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")


@_query(f"""WITH p AS (SELECT page_id, {_HOST} AS host, {_TITLE_SQL} AS name FROM pages),
v AS (SELECT host, name, 3 * count(*) + CASE WHEN len(string_split(any_value(name), ' ')) <= 4 THEN 2 ELSE 0 END AS score, min(page_id) AS first FROM p WHERE name <> '' GROUP BY ALL)
SELECT host, name, score FROM v QUALIFY row_number() OVER (PARTITION BY host ORDER BY score DESC, first) = 1""")
def name_vote(table):
    """A site's name: the title that most of its pages have; short names lead a little."""
    name, size = t.html_field("html", "title"), F.size(F.split("name", " "))
    named = table("pages").select("page_id", t.host("url").alias("host"), name.alias("name")).where("name <> ''")
    votes = named.groupBy("host", "name").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
    votes = votes.withColumn("score", F.col("n") * 3 + F.when(size <= 4, 2).otherwise(0))
    best = F.max(F.struct("score", (-F.col("first")).alias("earlier"), "name")).alias("best")
    return votes.groupBy("host").agg(best).select("host", "best.name", "best.score")


@_query("SELECT conv_id, role, count(*) AS n, min(turn) AS first_turn, arg_max(md5(coalesce(text, '')), length(coalesce(text, '')) * 1000000 - turn) AS longest FROM conversations GROUP BY ALL")
def contact_merge(table):
    """The rows of a group that are alike become one, which keeps the longest text, of equals the first."""
    text = F.coalesce("text", F.lit(""))
    longest = F.max_by(F.md5(text), F.struct(F.length(text), -F.col("turn")))
    return table("conversations").groupBy("conv_id", "role").agg(F.count("*").alias("n"), F.min("turn").alias("first_turn"), longest.alias("longest"))


@_query("""WITH s AS (SELECT s_suppkey, 'supplier' AS a, regexp_replace(split_part(s_name, '#', 2), '^0+', '') AS b FROM supplier)
SELECT s_suppkey, CASE WHEN b = '' THEN '' ELSE array_to_string(list_transform([a||'.'||b, a||b, left(a, 1)||b, a, b], lambda x: x || '@n.example'), ';') END AS guesses FROM s""")
def email_patterns(table):
    last = F.regexp_replace(F.split_part("s_name", F.lit("#"), F.lit(2)), "^0+", "")
    guesses = rules.email_guesses(F.lit("Supplier"), last, F.lit("n.example"))
    return table("supplier").select("s_suppkey", F.array_join(guesses, ";").alias("guesses"))


@_query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(table):
    return table("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@_query("""WITH RECURSIVE r AS (SELECT row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS i, c_custkey, c_nationkey, c_mktsegment, c_acctbal FROM customer),
w AS (SELECT 0::BIGINT AS z, []::STRUCT(id BIGINT, k INT, s VARCHAR)[] AS p UNION ALL SELECT r.i, CASE WHEN len(p) < 100 AND len(list_filter(p, lambda x: x.k = c_nationkey)) < 12 AND len(list_filter(p, lambda x: x.s = c_mktsegment)) < 34
  THEN list_append(p, {'id': c_custkey, 'k': c_nationkey, 's': c_mktsegment}) ELSE p END FROM w JOIN r ON r.i = w.z + 1), l AS (SELECT list_transform(p, lambda x: x.id) AS ids FROM w ORDER BY z DESC LIMIT 1)
SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal, NOT list_contains(ids, c_custkey) AS _fill FROM (SELECT *, row_number() OVER (PARTITION BY list_contains(ids, c_custkey) ORDER BY i) AS n FROM r, l) WHERE list_contains(ids, c_custkey) OR n <= 100 - len(ids)""")
def quota_pick(table):
    """A hundred customers, the richest first, at most 12 of a nation and 34 of a segment, then filled up."""
    rows = table("customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    return m.quota_pick(rows, {"c_nationkey": 12, "c_mktsegment": 34}, [F.desc("c_acctbal"), F.asc("c_custkey")], 100)
