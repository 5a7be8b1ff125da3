"""Queries on what is searched for and written to whom; each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkquarry.functions import contacts as c
from sparkquarry.functions import js, pages
from sparkquarry.functions import names as n
from sparkquarry.functions import values as v
from sparkquarry.operators import context, records, rules
from sparkquarry.operators import gates as g
from sparkquarry.plans.catalogue import _HOST, _query
from sparkquarry.plans.company import _ROLE, _TAGS, _WHAT, _domain
from sparkquarry.plans.samples import sample, sql
from sparkquarry.plans.web import _lined, _named
from sparkquarry.stored import cut

_LEADS = sql("leads")
_T, _S, _F, _E = js.sql_test, js.sql_sub, js.sql_first, js.sql_clean


def _unique(x: str) -> str:
    return f"list_filter({x}, lambda u, i: u <> '' AND list_position({x}, u) = i)"


_SEARCHES = ", ".join("'" + form.replace("'", "''").replace("{company}", "' || company || '").replace("{city}", "' || city || '") + "'" for form in rules.SIGNAL_SEARCHES)
_SITES = "CASE WHEN h <> '' THEN 'site:' || h || ' careers maintenance production operations' ELSE '' END, CASE WHEN h <> '' THEN 'site:' || h || ' expansion \"new facility\" \"new plant\"' ELSE '' END"


@_query(f"""SELECT id, len(q) AS n, md5(array_to_string({_unique('q')}, chr(10))) AS queries FROM (SELECT id, [{_SEARCHES}, {_SITES}] AS q FROM (SELECT *, {_domain('website')} AS h FROM {_LEADS}))""")
def signal_searches(table):
    """What is searched for to learn of a company's hiring and growth."""
    made = rules.signal_searches(F.col("company"), F.col("city"), n.domain_key("website"))
    every = F.lit(len(rules.SIGNAL_SEARCHES) + 2)
    return sample(table, "leads").select("id", every.alias("n"), F.md5(F.array_join(made, "\n")).alias("queries"))


@_query(f"""SELECT id, unnest(list_transform([{', '.join(js.quoted(f) for f in rules.PEOPLE_SEARCHES)}], lambda f: replace(f, '{{alias}}', company))) AS query FROM {_LEADS}""")
def people_searches(table):
    """What is searched for to find a company's people, for a name as it stands."""
    return sample(table, "leads").select("id", F.explode(rules.people_searches(F.array("company"))).alias("query"))


_PARTS = f"list_filter(string_split({_S(_S('lower(person)', '[^a-z\\s' + chr(39) + '-]', ' '), r'\s+', ' ')}, ' '), lambda p: p <> '' AND NOT regexp_matches(p, '^(mr|mrs|ms|dr|prof|sir|madam)$'))"


@_query(f"""WITH p AS (SELECT id, list_transform({_PARTS}, lambda x: {_S('x', '[^a-z0-9]', '')}) AS p FROM (SELECT id, CASE WHEN id % 3 = 0 THEN 'Dr. ' ELSE '' END || person AS person FROM {_LEADS})), f AS (SELECT id, p[1] AS f, CASE WHEN len(p) > 1 THEN p[len(p)] ELSE '' END AS l FROM p)
SELECT id, array_to_string({_unique("[CASE WHEN l <> '' THEN f || '.' || l || '@x.example' ELSE '' END, CASE WHEN l <> '' THEN f || l || '@x.example' ELSE '' END, CASE WHEN l <> '' THEN left(f, 1) || l || '@x.example' ELSE '' END, f || '@x.example', CASE WHEN l <> '' THEN l || '@x.example' ELSE '' END]")}, '; ') AS addresses FROM f""")
def personal_emails(table):
    """Likely mail addresses of every contact, without the title before the name."""
    name = F.concat(F.when(F.col("id") % 3 == 0, "Dr. ").otherwise(""), "person")
    return sample(table, "leads").select("id", F.array_join(rules.personal_addresses(name, F.lit("WWW.x.example")), "; ").alias("addresses"))


@_query(f"""WITH c AS (SELECT nation, count(*) AS k, count(*) FILTER (WHERE {_T(_WHAT, v.STRONG_ROLE)}) AS strong FROM {_LEADS} GROUP BY 1),
r AS (SELECT id, strong, k - strong AS weak, k, list_contains({_TAGS}, 'a') AS tagged, contains(news, 'plant') AS verified, {_T('says', 'verified plant lead|plant')} AS said, last_contact <> '' AS done FROM {_LEADS} l JOIN c USING (nation))
SELECT id, CASE WHEN strong >= 2 THEN CASE WHEN weak > 0 THEN 5 ELSE 0 END ELSE 10 + (2 - strong) * 20 + CASE WHEN k = 0 THEN 40 ELSE 0 END + CASE WHEN weak > 0 THEN 15 ELSE 0 END + CASE WHEN tagged THEN 35 ELSE 0 END
  + CASE WHEN verified THEN 20 ELSE 0 END + CASE WHEN said THEN 15 ELSE 0 END - CASE WHEN done THEN 5 ELSE 0 END END AS score FROM r""")
def sweep_targets(table):
    """How much each company would gain by another search for contacts."""
    leads = sample(table, "leads")
    counts = leads.groupBy("nation").agg(F.count("*").alias("k"), F.count_if(js.test(js.clean("title"), v.STRONG_ROLE)).alias("strong"))
    rows = leads.join(counts, "nation")
    tagged = F.array_contains(records.tag_list(F.col("tags")), "a")
    score = rules.sweep_score(F.col("strong"), F.col("k") - F.col("strong"), F.col("k"), 2, ~tagged, F.contains("news", F.lit("plant")), js.test("says", "verified plant lead|plant"), F.col("last_contact") != "")
    return rows.select("id", score.alias("score"))


@_query(f"""SELECT id, '2026-01-02 9:05 AM' || chr(10) || 'Template: intro' || chr(10) || 'Contact: ' || person || CASE WHEN title <> '' THEN ', ' || title ELSE '' END || chr(10) || 'Contact row: manufacturer_contacts #' || id || chr(10) ||
  CASE id % 3 WHEN 0 THEN 'Result: sent' || chr(10) || 'Emails that seemed to go through: a@x' || chr(10) || 'Failed: b@x, c@x' WHEN 1 THEN 'Result: all failed' || chr(10) || 'Emails tried: a@x, b@x' ELSE 'Result: nothing sent (daily limit or empty candidate list)' END AS note FROM {_LEADS}""")
def run_notes(table):
    """What a run notes of each contact it wrote to."""
    lists = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    kind = F.col("id") % 3
    sent = F.when(kind == 0, lists("a@x")).otherwise(lists())
    failed = F.when(kind == 0, lists("b@x", "c@x")).otherwise(lists())
    tried = F.when(kind == 1, lists("a@x", "b@x")).otherwise(lists())
    note = rules.run_note(F.lit("2026-01-02 9:05 AM"), F.lit("intro"), F.col("person"), F.col("title"), F.col("id"), sent, failed, tried)
    return sample(table, "leads").select("id", note.alias("note"))


_HEADS = f"""SELECT host, page_id * 10 + 1 AS pos, {_named(_lined(_F('html', r'<title[^>]*>([\s\S]*?)</title>', 1)))} AS name FROM p UNION ALL SELECT host, page_id * 10 + 2, {_named(_lined(_F('html', r'<h1[^>]*>([\s\S]*?)</h1>', 1)))} FROM p"""
_OWN = "len(list_filter(tokens, lambda t: contains(lower(name), t))) > 0"


@_query(f"""WITH p AS (SELECT *, {_HOST} AS host FROM pages), h AS ({_HEADS}), g AS (SELECT * FROM h WHERE length(name) >= 3 AND lower(name) NOT IN ({', '.join(map(js.quoted, v.PAGE_LABELS))})),
k AS (SELECT *, count(*) OVER (PARTITION BY host, lower(name)) AS times, list_transform(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(string_split(host, '.')[1], '(?i)([a-z])([0-9])', '\\1 \\2', 'g'), '(?i)([0-9])([a-z])', '\\1 \\2', 'g'), '[^a-zA-Z0-9]+'), lambda t: length(t) >= 2), lambda t: lower(t)) AS tokens FROM g),
s AS (SELECT *, times * 3 + CASE WHEN {_OWN} THEN 6 ELSE 0 END + CASE WHEN len(regexp_split_to_array(name, ' +')) <= 4 THEN 2 ELSE 0 END - CASE WHEN {_T('lower(name)', r'\b(404|not found|official site)\b', '')} THEN 8 ELSE 0 END
  - CASE WHEN {_T('lower(name)', r'\b(company|solutions|services)\b', '')} AND NOT {_OWN} THEN 3 ELSE 0 END AS score FROM k)
SELECT host, regexp_replace(name, '\\.$', '') AS name, score FROM s QUALIFY row_number() OVER (PARTITION BY host ORDER BY score DESC, pos) = 1""")
def site_names(table):
    """A site's company: of all its pages' headings the one that fits best, of equals the first."""
    found = table("pages").select("page_id", pages.title(F.col("html")).alias("t"), pages.heading(F.col("html")).alias("h"), n.domain_key("url").alias("host"))
    heads = found.select("host", F.posexplode(F.array("t", "h")).alias("at", "name"), (F.col("page_id") * 10).alias("page")).where((F.length("name") >= 3) & ~F.lower("name").isin(*v.PAGE_LABELS))
    # Counted once a host and heading; a site's headings stay together only as long as they are different.
    votes = heads.groupBy("host", F.lower("name").alias("low")).agg(F.count("*").alias("times"), F.collect_set(F.struct("name", (F.col("page") + F.col("at")).alias("pos"))).alias("as"))
    first = votes.select("host", "times", F.explode("as").alias("a")).groupBy("host", "times", "a.name").agg(F.min("a.pos").alias("pos"))
    scored = first.withColumn("score", pages.name_score(F.col("name"), pages.host_tokens(F.col("host")), F.col("times")))
    best = scored.groupBy("host").agg(F.max(F.struct("score", (-F.col("pos")).alias("earlier"), "name")).alias("b"))
    return best.select("host", F.regexp_replace("b.name", r"\.$", "").alias("name"), "b.score")


_SENTENCES = f"list_filter(regexp_extract_all(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r]+', ' ', 'g'), '[^.!?]*[.!?]+|[^.!?]+'), lambda s: length(trim(s)) >= 30 AND {_T('s', v.EVIDENCE)})"


@_query(f"""SELECT doc_id, len(list_filter(list_transform({_SENTENCES}, lambda s: trim(s)), lambda u, i: true)) > 0 AS proven FROM documents""")
def document_evidence(table):
    """Do sentences of a document tell of a plant?"""
    return table("documents").select("doc_id", (F.size(records.evidence(F.col("text"))) > 0).alias("proven"))


@_query(f"""WITH l AS (SELECT *, {_ROLE} AS role FROM {_LEADS}), c AS (SELECT nation, id, person FROM {_LEADS} WHERE id % 5 < 2 AND regexp_matches(person, '^[A-Z][a-z]+ [A-Z][a-z]+$')),
r AS (SELECT nation, id, person || ' - ' || title AS title, role FROM l WHERE id % 5 >= 2)
SELECT c.id AS candidate, min(r.id) AS result, min_by(r.role, r.id) AS role FROM c JOIN r ON c.nation % 3 = r.nation % 3 AND contains(lower(regexp_replace(r.title, '[^A-Za-z0-9]+', ' ', 'g')), lower(c.person)) WHERE r.role <> '' GROUP BY 1""")
def repaired_titles(table):
    """Roles of contacts without a title, from results of the same company that name them."""
    leads = sample(table, "leads").withColumn("group", F.col("nation") % 3)
    people = leads.where("id % 5 < 2").where(F.regexp_like("person", F.lit("^[A-Z][a-z]+ [A-Z][a-z]+$"))).select("group", F.col("id").alias("candidate"), n.company_key("person").alias("who"))
    told = F.concat("person", F.lit(" - "), "title")
    results = leads.where("id % 5 >= 2").select("group", F.col("id").alias("result"), n.company_key(told).alias("text"), c.role_in(F.col("title")).alias("role")).where("role <> ''")
    # Equal names, and equal texts, of a group are compared once; of a text its first result counts.
    people, first = cut(people, "people"), results.groupBy("group", "text").agg(F.min("result").alias("result"), F.min_by("role", "result").alias("role"))
    first = cut(first, "first-results")
    names = people.select("group", F.col("who").alias("pattern"), F.array("who").alias("parts")).distinct()
    met = context.contained(names, first.select("group", "text", F.col("text").alias("body")), "group").join(first, ["group", "text"])
    told = met.groupBy("group", F.col("pattern").alias("who")).agg(F.min("result").alias("result"), F.min_by("role", "result").alias("role"))
    return people.join(told, ["group", "who"]).select("candidate", "result", "role")


@_query(f"""SELECT id, CASE WHEN closed THEN '' ELSE CASE WHEN id % 2 = 0 THEN 'ready' ELSE 'open' END END AS state FROM (SELECT *, {_T(_E('stage'), v.CLOSED_STAGE)} AS closed FROM {_LEADS}) WHERE contains(lower(company), 'foods') OR lower({_E('city')}) = 'guelph'""")
def filtered_leads(table):
    """Leads that a word in any case of letters is part of, or of one city."""
    leads = sample(table, "leads").where(F.contains(F.lower("company"), F.lit("foods")) | (F.lower(js.clean("city")) == "guelph"))
    return leads.select("id", F.when(g.is_closed(F.col("stage")), "").when(F.col("id") % 2 == 0, "ready").otherwise("open").alias("state"))


@_query(f"""SELECT 'facility' AS record_type, company, '' AS name, 'plant' AS title_or_type, address, city, 'ON' AS province, '' AS postal_code, phone, '' AS fax, '' AS email, '' AS linkedin_url, website AS source_url, '' AS notes FROM {_LEADS} WHERE address <> ''
UNION ALL SELECT 'contact', company, person, title, '', '', '', '', phone, '', '', link, '', news FROM {_LEADS} WHERE title <> ''""")
def flat_records(table):
    """The flat file's fourteen columns: a row for every facility and every contact."""
    leads = sample(table, "leads")
    place = F.array(F.struct(F.lit("plant").alias("facility_type"), "address", "city", F.lit("ON").alias("province"), "phone", F.col("website").alias("source_url")))
    who = F.array(F.struct(F.col("person").alias("name"), "title", "phone", F.col("link").alias("linkedin_url"), F.col("news").alias("notes")))
    return records.flattened(leads.select("company", F.filter(place, lambda p: p["address"] != "").alias("facilities"), F.filter(who, lambda p: p["title"] != "").alias("contacts")))


@_query(f"""SELECT id, CASE WHEN v IS NULL THEN -1.0 WHEN {js.sql_trim('v')} = '' THEN 0.0 ELSE coalesce(CASE WHEN regexp_matches({js.sql_trim('v')}, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$') THEN CAST({js.sql_trim('v')} AS DOUBLE) END, -1.0) END AS number
  FROM (SELECT id, CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN CAST(id AS STRING) || '.5' WHEN 3 THEN '12 a' ELSE ' -' || CAST(id AS STRING) END AS v FROM {_LEADS})""")
def read_numbers(table):
    k, text = F.col("id") % 5, F.col("id").cast("string")
    value = F.when(k == 1, " ").when(k == 2, F.concat(text, F.lit(".5"))).when(k == 3, "12 a").when(k == 4, F.concat(F.lit(" -"), text))
    return sample(table, "leads").select("id", records.number(value, -1.0).alias("number"))


@_query(f"""SELECT id, CASE WHEN q THEN 'Plant Verified - Needs Contact' ELSE 'Plant Verified - Needs Contact + Products' END AS stage, 'plant-verified | contact:missing | products:' || CASE WHEN q THEN 'confirmed' ELSE 'missing' END AS tags,
  CASE WHEN q THEN 'own line' ELSE 'Not confidently confirmed from public pages yet.' END AS products FROM (SELECT id, id % 2 = 0 AS q FROM {_LEADS})""")
def lead_intelligence(table):
    """Leads as they are put together before contacts are looked for."""
    nothing = g.verify_plant(*[F.lit("")] * 4, F.array().cast("array<string>"))
    found = F.when(F.col("id") % 2 == 0, F.array(F.lit(" own  line"), F.lit("own line"))).otherwise(F.array().cast("array<string>"))
    leads = sample(table, "leads").withColumn("v", nothing)
    made = records.intelligence(F.col("v"), F.col("company"), found, F.array("says"), F.col("website"), F.col("website"), F.col("city"))
    return leads.select("id", made.alias("m")).select("id", "m.stage", "m.tags", "m.products")


@_query(f"""SELECT id, concat_ws(' - ', {_E('news')}, {_E('says')}) AS snippets, CASE WHEN website = '' THEN '' ELSE {_E('website')} END AS urls FROM {_LEADS} WHERE NOT {_T('says', v.EVIDENCE)}""")
def evidence_packets(table):
    """What is given to a verifier of leads whose own text says nothing of a plant."""
    made = records.packet(F.col("says"), F.array("news", "says", "news"), F.array("website", "website"))
    rows = sample(table, "leads").where(~js.test("says", v.EVIDENCE)).select("id", made.alias("p"))
    return rows.select("id", F.array_join("p.snippets", " - ").alias("snippets"), F.array_join("p.urls", " - ").alias("urls"))


_SOLO = "regexp_matches(person, '^(Mike|Anne-Marie|Robert|Jane|Liz|Joe) (Doe|Miller|Stone|O''Hara|B. Smith)$')"


_SEEN = "CASE WHEN id % 4 = 1 THEN 'Jan 2019 - Mar 2021 there' ELSE 'is there' END"
_TERMS = rf"\b(?:{'|'.join(v.TITLE_TERMS)})\b"
_PAGE_ROLE = r"\b(?:about\s+.+?\s+)?(?:is|works as)\s+(?:currently\s+)?(?:a|an|the)?\s*([^.,|]{3,100})(?:$|\s+at\s+)"
_AROUND = (r"\s*\|\s*LinkedIn.*$", r"\s+-\s+(?:Wiza|RocketReach|ZoomInfo).*$", r"\s+[·|].*$", r"^experience:\s*", r"^as\s+", r"\s+\.{3,}.*$", r"\s+at\s+.*$", r"\s+(?:and|&)\s*$")


def _role_text(x: str) -> str:
    told, plain = _F(x, _PAGE_ROLE, 1), _S(x, r"\bBrewing\s+Assist\.?\.?", "Brewing Assistant", "i")
    for pattern in _AROUND:
        plain = _S(plain, pattern, "", "i")
    bare = lambda y: js.sql_trim(_S(y, "^[-,|]+|[-,|]+$", ""))
    return f"CASE WHEN {_T(x, v.DIRECTORY_TITLE)} AND {told} <> '' THEN {bare(_E(told))} ELSE {bare(plain)} END"


def _useful(x: str) -> str:
    excluded = f"({_T(x, v.EXCLUDED_TITLE)} AND NOT {_T(x, v.EXCLUDED_BUT)})"
    return f"({x} <> '' AND length({x}) <= 140 AND NOT {_T(x, v.WEAK_TITLE)} AND NOT {excluded} AND {_T(x, _TERMS)})"


@_query(f"""WITH p AS (SELECT id, person, link, {_E("person || ' - ' || title || ' - X | LinkedIn'")} AS page, {_SEEN} AS snippet FROM {_LEADS} WHERE contains(link, 'linkedin') AND id % 4 <> 1),
s AS (SELECT *, page || ' ' || snippet AS title, array_to_string(string_split({_S('page', r'\s*\|\s*LinkedIn\s*$', '', 'i')}, ' - ')[2:], ' - ') AS own, {_F('snippet', r'^([^.|]{4,120}?)\s+at\s+', 1)} AS told FROM p),
r AS (SELECT *, {_ROLE} AS seen, {_role_text('own')} AS own_role, {_role_text('told')} AS told_role FROM s)
SELECT id, CASE WHEN {_SOLO} THEN person ELSE '' END AS name, CASE WHEN seen <> '' THEN seen WHEN {_useful('own_role')} THEN own_role WHEN {_useful('told_role')} THEN told_role ELSE '' END AS role,
  CASE WHEN contains(link, 'linkedin') THEN 'https://www.linkedin.com/in/p-' || (id % 40) ELSE '' END AS profile FROM r""")
def profile_contacts(table):
    """Contacts in profile pages among search results, also those whose role isn't told; roles that have ended are left out."""
    title = F.concat("person", F.lit(" - "), "title", F.lit(" - X | LinkedIn"))
    snippet = F.when(F.col("id") % 4 == 1, "Jan 2019 - Mar 2021 there").otherwise("is there")
    # Unfolded instead of filtered by null: a filter would be pushed below and work the contact out twice.
    rows = sample(table, "leads").select("id", F.inline(F.array_compact(F.array(c.profile_contact(title, snippet, F.col("link"))))))
    return rows.select("id", "name", F.col("title").alias("role"), F.col("link").alias("profile"))
