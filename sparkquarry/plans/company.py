"""Queries on companies and contacts: keys, gates, scores, records; each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkquarry.functions import contacts as c
from sparkquarry.functions import dates, js, pages
from sparkquarry.functions import names as n
from sparkquarry.functions import values as v
from sparkquarry.operators import gates as g
from sparkquarry.operators import records as rec
from sparkquarry.plans.catalogue import _query
from sparkquarry.plans.samples import dealt, sample, sql
from sparkquarry.stored import worked_out

_LEADS = sql("leads")
_T, _S, _F, _E = js.sql_test, js.sql_sub, js.sql_first, js.sql_clean
_joined = lambda col, by="; ": F.array_join(col, by)


def _decoded(x: str) -> str:
    for entity, to in v.ENTITIES_RESEARCH:
        x = f"replace({x}, {js.quoted(entity)}, {js.quoted(to)})"
    return x


def _squeezed(x: str) -> str:
    return f"trim({_S(x, '[^a-z0-9]+', ' ')})"


def _key(x: str, words: str) -> str:
    return _squeezed(_S(_S(f"lower({x})", "&", " and "), rf"\b(?:{words})\b", " "))


def _company(x: str) -> str:
    return _squeezed(f"lower({_decoded(x)})")


def _tokens(x: str) -> str:
    no = ", ".join(map(js.quoted, v.NOT_TOKENS))
    return f"list_filter(string_split({_company(x)}, ' '), lambda w: length(w) > 1 AND w NOT IN ({no}))"


def _person(x: str) -> str:
    key = f"lower({_E(x)})"
    for short, full in v.NICKNAMES:
        key = _S(key, rf"\b{short}\b", full)
    return _squeezed(_S(key, r"\b[a-z]\.?\b", " "))


def _address(x: str) -> str:
    key = f"lower({x})"
    for word, short in v.STREET_WORDS:
        key = _S(key, rf"\b{word}\b", f" {short} ")
    return _squeezed(_S(_S(key, v.POSTAL, " ", "i"), r"\b(?:ontario|canada|on)\b", " "))


def _domain(x: str) -> str:
    entry = f"coalesce(list_filter(regexp_split_to_array({js.sql_trim(x)}, {js.quoted('[;,|' + js._RE2_SPACE + ']+')}), lambda e: contains(e, '.'))[1], '')"
    rest = _S(_S(entry, "^[a-z][a-z0-9+.-]*://", "", "i"), "^[^/?#]*@", "")
    host = f"lower({_S(_S(_S(rest, '[/?#].*$', '', 's'), ':[0-9]*$', ''), '^www[.]', '', 'i')})"
    return f"CASE WHEN {host} = 'linkedin.com' THEN '' ELSE {host} END"


def _digits(x: str) -> str:
    return _S(x, "[^0-9]+", "")


_PROFILE = f"CASE WHEN {_T('link', r'linkedin[.]com/in/')} THEN {_S(_S('link', '[?#].*$', ''), '/+$', '')} ELSE '' END"


@_query(f"""SELECT id, {_key('company', v.LEGAL)} AS dedupe_name, {_key(_decoded('company'), v.CENSUS_WORDS)} AS census_name, {_key(_decoded('company'), v.SEARCH_WORDS)} AS search_name,
  {_company('company')} AS company_key, array_to_string({_tokens('company')}, ' ') AS tokens, {_person('person')} AS person_key, {_address('address')} AS address_key,
  CASE WHEN length({_digits('phone')}) < 10 THEN '' ELSE right({_digits('phone')}, 10) END AS phone_key, {_domain('website')} AS domain_key,
  CASE WHEN length(d) = 10 THEN d[1:3] || '-' || d[4:6] || '-' || d[7:10] ELSE '' END AS phone_shown
  FROM (SELECT *, regexp_replace({_digits('phone')}, '^1([0-9]{{10}})$', '\\1') AS d FROM {_LEADS})""")
def company_keys(table):
    """Every key that companies and persons are compared by."""
    return sample(table, "leads").select(
        "id", n.dedupe_name("company").alias("dedupe_name"), n.census_name("company").alias("census_name"), n.search_name("company").alias("search_name"),
        n.company_key("company").alias("company_key"), _joined(n.company_tokens("company"), " ").alias("tokens"), n.person_key("person").alias("person_key"),
        n.address_key("address").alias("address_key"), n.phone_key("phone").alias("phone_key"), n.domain_key("website").alias("domain_key"), n.phone_dashed("phone").alias("phone_shown"),
    )


_SHOWN = _E(_decoded(_S(_S(_S(_S('company', r'^(about|location|homepage)\s*-\s*', '', 'i'), r'\s*,\s*$', ''), r'^(contact|contacts|product|products|about|location|locations|home|homepage)\s*-\s*', '', 'i'), r'\s+-\s+\d{1,6}\s+.*$', '', 'i')))
_SUFFIX_RE = rf"\b(?:{v.SUFFIX_WORDS})\.?$"


@_query(f"""WITH a AS (SELECT id, {_SHOWN} AS a FROM {_LEADS}),
b AS (SELECT id, a, {js.sql_trim(_S('a', _SUFFIX_RE, '', 'i'))} AS s, list_filter(string_split({_S('a', '[()]', ' ')}, ' '), lambda w: w <> '' AND NOT {_T('w', rf'^({v.SUFFIX_WORDS}|and|the)$')}) AS words FROM a),
l AS (SELECT id, [a, CASE WHEN s <> '' AND s <> a THEN s END, CASE WHEN {_T('a', r'\band\b')} THEN {_S('a', r'\band\b', '&', 'i')} END, CASE WHEN contains(a, '&') THEN replace(a, '&', 'and') END,
  CASE WHEN len(words) >= 2 THEN words[1] || ' ' || words[2] END] AS l FROM b),
u AS (SELECT id, unnest(l) AS alias, generate_subscripts(l, 1) AS pos FROM l), d AS (SELECT id, alias, min(pos) AS pos FROM u WHERE length(alias) >= 3 GROUP BY ALL),
s AS (SELECT *, CASE WHEN contains(alias, ' ') THEN 0 ELSE 12 END + CASE WHEN {_T('alias', v.JUNK_ALIAS)} THEN 40 ELSE 0 END + CASE WHEN length(alias) > 45 THEN 12 ELSE 0 END
  - CASE WHEN len(string_split(alias, ' ')) BETWEEN 2 AND 5 THEN 8 ELSE 0 END - CASE WHEN contains(alias, '&') THEN 2 ELSE 0 END AS score FROM d)
SELECT id, string_agg(alias, '; ' ORDER BY score, pos) AS aliases FROM s GROUP BY id""")
def company_aliases(table):
    """Names to search a company by, the likeliest first."""
    return sample(table, "leads").select("id", _joined(n.best_aliases("company")).alias("aliases"))


_TEXT = "concat_ws(chr(10), nullif(company, ''), 'plants in ' || city, nullif(title, ''), nullif(website, ''), nullif(says, ''), nullif('Facility: ' || address || '. Phone: ' || phone, ''))"
_REAL = f"(trim(company) <> '' AND NOT {_T('company', v.PAGE_NAME)} AND NOT {_T('t', v.PAGE_TEXT)})"
_OPERATOR = f"({_REAL} AND {_T('t', v.OPERATES)} AND NOT {_T('t', v.VENDOR)})"
_PLACED = _T("t", v.PLANT_ADDRESS + r"\b")
_MAKES = f"({_OPERATOR} AND {_T('t', v.MAKES)})"
_SCALE = f"({_MAKES} AND {_T('t', v.SCALE)})"
_REASON = " ".join(f"WHEN NOT {test} THEN {js.quoted(reason)}" for test, reason in zip((_REAL, _OPERATOR, _PLACED, _MAKES, _SCALE), v.GATE_REASONS))


def _labels(table, other: str) -> str:
    found = ", ".join(f"CASE WHEN {_T('lower(t)', p, '')} THEN {js.quoted(label)} END" for p, label in table)
    return f"CASE WHEN q THEN coalesce(nullif(concat_ws('; ', {found}), ''), {js.quoted(other)}) ELSE '' END"


_EQUIPMENT_SQL = " ".join(f"WHEN {_T('lower(t)', p, '')} THEN {js.quoted('; '.join(words))}" for p, words in v.EQUIPMENT)
_WHERE = _F("t", v.PLANT_ADDRESS + r"[^.\n]*")


@_query(f"""WITH t AS (SELECT *, {_TEXT} AS t FROM {_LEADS}), q AS (SELECT *, {_SCALE} AND {_PLACED} AS q FROM t)
SELECT id, q AS qualified, CASE {_REASON} ELSE '' END AS reason, CASE WHEN q THEN 'medium' ELSE 'low' END AS confidence,
  CASE WHEN q THEN trim({_F(_WHERE, r",\s*([A-Za-z .'-]+),\s*(?:ON|Ontario)" + r"\b", 1)}) ELSE '' END AS city, CASE WHEN q THEN {_WHERE} ELSE '' END AS address, CASE WHEN q THEN {_F('t', v.PLANT_PHONE)} ELSE '' END AS phone,
  {_labels(v.END_PRODUCTS, v.ANY_PRODUCT)} AS products, {_labels(v.PLANT_NAMES, v.ANY_PLANT)} AS plants, CASE WHEN q THEN CASE {_EQUIPMENT_SQL} END ELSE '' END AS equipment FROM q""")
def plant_verdicts(table):
    """What the five gates say of every lead, and what is found of those that pass."""
    place = F.concat(F.lit("Facility: "), "address", F.lit(". Phone: "), "phone")
    verdict = g.verify_plant(F.col("company"), F.concat(F.lit("plants in "), "city"), F.col("title"), F.col("website"), F.array(F.col("says"), place))
    out = sample(table, "leads").select("id", verdict.alias("v"))
    return out.select(
        "id", "v.qualified", F.col("v.reject_reason").alias("reason"), "v.confidence", *[F.coalesce(f"v.facility.{c}", F.lit("")).alias(c) for c in ("city", "address", "phone")],
        _joined("v.end_products").alias("products"), _joined("v.production_related_names").alias("plants"), _joined("v.likely_equipment").alias("equipment"),
    )


_GUARD = "concat_ws(' ', nullif(company, ''), nullif(stage, ''), nullif(says, ''), nullif(address || ' ' || phone, ''), nullif(tags, ''))"
_HINTS = " OR ".join(f"contains(' ' || lower(t) || ' ', {js.quoted(h)})" for h in (*v.REJECT_HINTS, *v.RANGE_HINTS, *v.PRODUCT_HINTS))


@_query(f"""SELECT id, {_E('company')} <> '' AND NOT ({_HINTS}) AND NOT {_T(_E('stage'), r'\bneeds products\b')} AND NOT {_T('t', v.STRICT_NO_PRODUCT)}
  AND {_T('t', v.STRICT_ADDRESS)} AND {_T('t', v.STRICT_PHONE, '')} AND {_T('t', v.STRICT_PLANT)} AS passes FROM (SELECT *, {_GUARD} AS t FROM {_LEADS})""")
def strict_guard(table):
    place = F.concat("address", F.lit(" "), "phone")
    passes = g.passes_strict_guard(F.col("company"), F.col("stage"), F.lit(None).cast("string"), F.col("says"), place, F.col("tags"), F.lit(""))
    return sample(table, "leads").select("id", passes.alias("passes"))


_BUCKET = "CASE " + " ".join(f"WHEN {_T('t', p)} THEN {js.quoted(x)}" for p, x in v.INDUSTRIES) + f" ELSE {js.quoted(v.OTHER_INDUSTRY)} END"
_FIT = "CASE " + " ".join(f"WHEN {_T('b', p, '')} THEN {js.quoted(x)}" for p, x in v.EQUIPMENT_FIT) + f" WHEN {_T('says', v.PROCESS_TEXT)} THEN {js.quoted(v.PROCESS_FIT)} ELSE {js.quoted(v.NO_FIT)} END"
_FOOD = ", ".join(f"CASE WHEN {_T('company', p)} THEN {js.quoted(x)} END" for x, p in v.FOOD_PRODUCTS)


@_query(f"""SELECT id, b AS industry, {_FIT} AS fit, coalesce(nullif(concat_ws('; ', {_FOOD}), ''), {js.quoted(v.ANY_FOOD)}) AS foods,
  52 + 24 * CAST({_T('company', v.REGISTRY_PROCESS)} AS INT) + 18 * CAST({_T('company', v.REGISTRY_PRODUCT)} AS INT) + 4 * CAST({_T('company', v.REGISTRY_LEGAL)} AS INT) - 8 * CAST({_T('company', r'^[0-9]+' + chr(92) + 'b')} AS INT) AS registry_score
  FROM (SELECT *, {_BUCKET} AS b FROM (SELECT *, company || ' ' || says AS t FROM {_LEADS}))""")
def industry_classes(table):
    bucket = g.industry(F.array("company"), F.col("says"))
    return sample(table, "leads").select(
        "id", bucket.alias("industry"), g.equipment_fit(bucket, F.col("says")).alias("fit"), _joined(g.food_products(F.col("company"))).alias("foods"),
        g.registry_score(F.col("company")).alias("registry_score"),
    )


_PARTS = ((_T("t", v.MAKER), 20, "manufacturer language"), (_T("t", v.STRONG_INDUSTRY), 30, "industrial/product keywords"), (_T("company", v.STRONG_CATEGORY), 16, "target category"),
          ("id % 3 = 0", 10, "multiple listed products"), (_T("t", v.COMMERCIAL), 12, "commercial/bulk signal"), (_T("t", v.PROCESS), 18, "equipment/process signal"),
          (_T("t", v.ARTISAN), -24, "small/artisan noise"), ("id % 4 = 0", 18, "CFIA food licence registry match"), ("website <> ''", 5, None), (_T("address", v.STREET_ADDRESS), 5, None),
          (f"({_T('t', v.ARTISAN)} AND NOT {_T('says', v.STRONG_INDUSTRY)})", -30, None))


@_query(f"""SELECT id, {' + '.join(f'{p} * CAST({t} AS INT)' for t, p, _ in _PARTS)} AS score, concat_ws('; ', {', '.join(f'CASE WHEN {t} THEN {js.quoted(r)} END' for t, _, r in _PARTS if r)}) AS reasons
  FROM (SELECT *, {_E("company || ' ' || says")} AS t FROM {_LEADS})""")
def census_scores(table):
    products = F.when(F.col("id") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    text = F.concat_ws(" ", "company", "says")
    score = g.census_score(text, F.array("company"), products, F.col("id") % 4 == 0, F.col("website"), F.col("address"), F.col("says"), F.col("company"))
    return sample(table, "leads").select("id", score.alias("s")).select("id", "s.score", _joined("s.reasons").alias("reasons"))


_WHO, _WHAT = _E("person"), _E("title")
_PERSON_SQL = f"({_T(_WHO, v.PERSON_SHAPE, '')} AND NOT {_T(_WHO, v.NOT_PERSON_START)} AND NOT {_T(_WHO, v.NOT_PERSON)})"
_TITLE_SQL = f"({_WHAT} <> '' AND NOT {_T(_WHAT, v.WEAK_TITLE)} AND NOT ({_T(_WHAT, v.EXCLUDED_TITLE)} AND NOT {_T(_WHAT, v.EXCLUDED_BUT)}) AND {_T(_WHAT, chr(92) + 'b(?:' + '|'.join(v.TITLE_TERMS) + ')' + chr(92) + 'b')})"
_SAVED = f"""({_T(_WHO, v.PERSON_SHAPE, '')} AND NOT {_T(_WHO, v.CRM_BLOCK)} AND {_WHAT} <> '' AND NOT {_T(_WHAT, v.CRM_WEAK)} AND NOT ({_T(_WHAT, v.CRM_EXCLUDE)} AND NOT {_T(_WHAT, v.CRM_EXCLUDE_BUT)})
  AND {_T(_WHAT, v.CRM_TARGET)} AND link <> '')"""
_ROLE = "CASE " + " ".join(f"WHEN {_T('title', p)} THEN {js.quoted(x)}" for p, x in v.ROLE_HINTS) + " ELSE '' END"


@_query(f"""SELECT id, {_PERSON_SQL} AND {_TITLE_SQL} AND link <> '' AS useful, {_SAVED} AS saved, {_T(_WHO, v.PERSON_SHAPE, '')} AND NOT {_T(_WHO, v.OUTREACH_BLOCK)} AND NOT {_T(_WHAT, v.OUTREACH_BAD)} AS writable,
  20 * CAST({_T(_WHAT, v.CRM_TARGET)} AS INT) + 5 * CAST({_T(_WHAT, v.OUTREACH_RANK)} AS INT) - 20 * CAST({_T(_WHAT, v.OUTREACH_BAD)} AS INT) + 2 * CAST(link <> '' AS INT) AS outreach_score,
  30 * CAST(p <> '' AS INT) + 8 * CAST(link <> '' AS INT) + 20 * CAST({_T(_WHAT, v.STRONG_ROLE)} AS INT) + 8 * CAST({_T(_WHAT, v.SCORED_ROLE)} AS INT) - 30 * CAST({_T(_WHAT, v.WEAK_TITLE)} AS INT) - 8 * CAST({_T(_WHAT, v.DIRECTORY_TITLE)} AS INT) AS contact_score,
  {_ROLE} AS role, p AS profile FROM (SELECT *, {_PROFILE} AS p FROM {_LEADS})""")
def contact_tests(table):
    name, title, link, none = F.col("person"), F.col("title"), F.col("link"), F.lit("")
    return sample(table, "leads").select(
        "id", c.is_useful(name, title, link, none, none).alias("useful"), c.is_worth_saving(name, title, link).alias("saved"), c.may_be_written_to(name, title).alias("writable"),
        c.outreach_score(title, link).alias("outreach_score"), c.contact_score(title, link, link, none).alias("contact_score"), c.role_in(title).alias("role"), c.linkedin_url(link).alias("profile"),
    )


@_query(f"""SELECT nation AS company_id, id AS pos, {_WHO} AS name, {_WHAT} AS title, link AS linkedin FROM {_LEADS} WHERE {_SAVED}
  QUALIFY row_number() OVER (PARTITION BY nation, lower({_WHO}), lower({_WHAT}), lower(link) ORDER BY id) = 1""")
def crm_contact_rows(table):
    rows = sample(table, "leads").select(F.col("nation").alias("company_id"), F.col("id").alias("pos"), F.col("person").alias("name"), "title", F.lit("").alias("linkedin"), F.col("link").alias("source_url"))
    return rec.crm_contacts(rows)


_TAGS = f"list_filter(list_transform(string_split(tags, '|'), lambda t: {_E('t')}), lambda t: t <> '')"
_DATED = "CASE WHEN regexp_matches(last_contact, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN last_contact ELSE '' END"


@_query(f"""WITH l AS (SELECT * FROM {_LEADS}), c AS (SELECT nation AS company_id, string_agg(concat_ws(', ', nullif({_WHO}, ''), nullif({_WHAT}, ''), nullif(link, '')), chr(10) ORDER BY id) AS contacts FROM l WHERE id % 2 = 0 GROUP BY 1)
SELECT id, {_E('company')} AS company, coalesce(nullif({_E('stage')}, ''), 'Prospect') AS stage, {_E('city')} AS industry, concat_ws(chr(10), nullif({_E('news')}, ''), 'End products: ' || nullif({_E('says')}, '')) AS notes,
  coalesce(c.contacts, '') AS contacts, array_to_string({_TAGS}, ' | ') AS tags, {_DATED} AS last_activity, list_contains({_TAGS}, '__finder_skip') AS finder_skip FROM l LEFT JOIN c ON id = company_id""")
def crm_records(table):
    leads = sample(table, "leads")
    companies = leads.select("id", "company", "stage", F.col("city").alias("industry"), F.col("says").alias("end_product"), F.col("news").alias("signals"), "last_contact", "tags")
    people = leads.where("id % 2 = 0").select(F.col("nation").cast("long").alias("company_id"), F.col("id").alias("pos"), F.col("person").alias("name"), "title", F.col("link").alias("linkedin"))
    return rec.existing_records(companies, people)


_WITH_MARKS = f"list_concat({_TAGS}, ['finder-sync', 'contacts-v2', 'batch-1'])"


@_query(f"""SELECT id, {_E('company')} AS company, 'Prospect' AS stage, CASE WHEN {_T('says', 'not confidently confirmed from public pages yet')} THEN '' ELSE {_E('says')} END AS end_product,
  coalesce(nullif({_DATED}, ''), '2026-01-02') AS last_contact, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i), ' | ') AS tags FROM (SELECT *, {_WITH_MARKS} AS t FROM {_LEADS})""")
def crm_payloads(table):
    made = rec.crm_payload(F.col("company"), F.col("city"), F.col("says"), F.col("notes"), F.col("last_contact"), F.col("tags"), ("finder-sync", "contacts-v2", "batch-1"), "2026-01-02")
    return sample(table, "leads").select("id", made.alias("p")).select("id", "p.company", "p.stage", "p.end_product", "p.last_contact", _joined("p.tags", " | ").alias("tags"))


_REACHABLE = f"({js.sql_trim('contacts')} <> '' AND NOT {_T('contacts', v.NO_CONTACT)})"
_SECTION = js.sql_trim(_F("notes", r"\*\*end products manufactured\*\*\s*([\s\S]*?)(?:\n\n\*\*|$)", 1))
_STAGE_LIST = ", ".join(map(js.quoted, v.STAGES))


@_query(f"""WITH a AS (SELECT *, {_REACHABLE} AS r, ({_SECTION} <> '' AND NOT {_T(_SECTION, v.NO_PRODUCTS)}) AS p FROM {_LEADS} WHERE NOT {_T('notes', v.NO_PLANT)}),
b AS (SELECT *, CASE WHEN {js.sql_trim('stage')} IN ({_STAGE_LIST}) THEN {js.sql_trim('stage')} WHEN NOT r AND NOT p THEN '{v.STAGES[3]}' WHEN NOT r THEN '{v.STAGES[2]}' WHEN NOT p THEN '{v.STAGES[1]}' ELSE '{v.READY}' END AS s FROM a),
t AS (SELECT *, list_concat(list_filter(list_transform(string_split(tags, '|'), lambda x: {js.sql_trim('x')}), lambda x: x <> ''), list_filter(['plant-verified', CASE WHEN s = '{v.READY}' THEN 'outreach-ready' END,
  CASE WHEN contains(tags, 'contact:linkedin-direct') THEN 'contact:linkedin-direct' WHEN contains(tags, 'contact:public-named') THEN 'contact:public-named' WHEN contains(tags, 'contact:leadership-fallback') THEN 'contact:leadership-fallback'
    WHEN NOT r THEN 'contact:missing' ELSE 'contact:public-named' END, CASE WHEN p THEN 'products:confirmed' ELSE 'products:missing' END], lambda x: x IS NOT NULL)) AS t FROM b)
SELECT id, company, s AS stage, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i), ' | ') AS tags FROM t""")
def saved_leads(table):
    """Saved leads with stage and tags worked out anew; those without a plant are gone."""
    lead = rec.saved_lead(F.col("company"), F.col("stage"), F.col("notes"), F.col("contacts"), F.col("tags"))
    return sample(table, "leads").select("id", F.inline(F.array_compact(F.array(lead))))


_LABEL = f"""CASE WHEN NOT ({_T('t', v.SIGNAL_INCLUDE)} OR {_T('t', v.SIGNAL_HIRING)} OR {_T('t', v.SIGNAL_GROWTH)}) THEN NULL WHEN {_T('t', v.SIGNAL_HIRING)} AND role <> '' THEN 'Hiring'
  WHEN NOT {_T('t', v.SIGNAL_GROWTH)} THEN NULL WHEN {_T('t', v.SIGNAL_PERMIT)} THEN 'Permit' WHEN {_T('t', v.SIGNAL_CAPACITY)} THEN 'Capacity' WHEN {_T('t', v.SIGNAL_PLANNED)} THEN 'Planned expansion' ELSE 'Expansion' END"""
_WRONG = f"""({_T('u', 'linkedin[.]com/company/')} OR {_T('t', v.SIGNAL_NEGATIVE)} OR ({_T('t', v.SIGNAL_OTHER_ROLE)} AND NOT {_T('t', v.SIGNAL_ROLE)}) OR ({_T('u', v.SIGNAL_JOB_BOARD)} AND {_T('t', v.SIGNAL_HIRING)} AND NOT {_T('t', v.SIGNAL_ROLE)})
  OR (coalesce(label, '') = 'Hiring' AND NOT {_T('t', v.SIGNAL_ROLE)}) OR ({_T('t', v.SIGNAL_OLD_YEAR)} AND NOT {_T('t', v.SIGNAL_NEW_YEAR)} AND NOT {_T('t', v.SIGNAL_CURRENT)}))"""
_SIGNAL_ROLE = "CASE " + " ".join(f"WHEN {_T('t', p)} THEN {js.quoted(x)}" for x, p in v.SIGNAL_ROLES) + " ELSE '' END"
_HAY = _company("t")


@_query(f"""WITH t AS (SELECT *, {_E('news')} || ' ' || CASE WHEN id % 2 = 0 THEN company ELSE 'elsewhere' END AS t, news_url AS u FROM {_LEADS}), r AS (SELECT *, {_SIGNAL_ROLE} AS role FROM t), l AS (SELECT *, {_LABEL} AS label FROM r),
h AS (SELECT *, {_company(_E('t'))} AS hay, {_company('company')} AS k, list_filter({_tokens('company')}, lambda w: length(w) >= 4) AS w FROM l)
SELECT id, label AS type, CASE WHEN label = 'Hiring' THEN role ELSE '' END AS role, coalesce(nullif({_F('t', v.DATE_HINT)}, ''), {_F('t', v.SIGNAL_NEW_YEAR)}) AS date FROM h
WHERE u <> '' AND label IS NOT NULL AND NOT {_WRONG} AND ((length(k) >= 4 AND contains(hay, k)) OR (len(w) >= 2 AND len(list_filter(w, lambda x: NOT contains(hay, x))) = 0) OR id % 7 = 0)""")
def recent_signals(table):
    """Results that tell of hiring or growth of the company searched for."""
    told = F.when(F.col("id") % 2 == 0, F.col("company")).otherwise("elsewhere")
    text = F.concat_ws(" ", js.clean("news"), told)
    named = g.names_company(text, F.array("company"), n.company_key, n.company_tokens)
    found = g.signal(F.col("news"), told, F.col("news_url"), named, F.col("id") % 7 == 0)
    return worked_out(sample(table, "leads"), s=found).where("s IS NOT NULL").select("id", "s.*")


@_query(f"""SELECT id, array_to_string(list_filter([CASE WHEN d <> '' AND NOT {_T('d', v.SKIP_HOSTS)} THEN 'domain:' || d END,
  CASE WHEN length(k) >= 5 AND NOT {_T('k', v.SKIP_NAMES)} AND c <> '' AND len(list_filter(string_split(k, ' '), lambda w: length(w) >= 5 AND w NOT IN ({', '.join(map(js.quoted, v.SKIP_TOKENS))}))) > 0 THEN 'name-city:' || k || '::' || c END], lambda x: x IS NOT NULL), '; ') AS keys
  FROM (SELECT id, {_domain('website')} AS d, {_key('company', v.LEGAL)} AS k, {_key('city', v.LEGAL)} AS c FROM {_LEADS})""")
def skip_cache_keys(table):
    return sample(table, "leads").select("id", _joined(rec.skip_keys(F.col("website"), F.col("company"), F.col("city"))).alias("keys"))


_GATE_TEXT = "(company || chr(10) || stage || chr(10) || news || chr(10) || says || chr(10) || tags)"
_GATE_BAD = f"({_T('company', v.GATE_PAGE_NAME)} OR {_T('company', r'[.][a-z]{2,}(?:' + chr(92) + 'b|$)')} OR {_T('company', v.GATE_HEAVY)})"


@_query(f"""SELECT id, {_T(_E('stage'), v.CLOSED_STAGE)} AS closed, NOT {_GATE_BAD} AND (id % 4 = 0 OR (NOT ({_T('company', v.GATE_EATING)} AND NOT {_T('company', v.GATE_BREWING)}) AND {_T(_GATE_TEXT, v.GATE_FOOD)}
  AND NOT ({_T(_GATE_TEXT, v.GATE_RETAIL)} AND NOT {_T(_GATE_TEXT, v.GATE_INDUSTRIAL)}))) AS passes FROM {_LEADS}""")
def lead_gates(table):
    wanted = F.when(F.col("id") % 4 == 0, "Metal").otherwise("food and  Beverage")
    passes = g.passes_lead_gate(F.col("company"), F.col("stage"), F.col("news"), F.col("says"), F.col("tags"), wanted)
    return sample(table, "leads").select("id", g.is_closed(F.col("stage")).alias("closed"), passes.alias("passes"))


_KNOWN = ", ".join(map(js.quoted, ("contact:missing", "contact:public-named", "contact:linkedin-direct", "needs-contact-backfill")))


@_query(f"""SELECT id, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i), ' | ') AS tags, {_E(_F('notes', r'(?:^|[\n])Website:\s*([^\n]+)', 1))} AS website, {_E(_F('address', v.CITIES))} AS city FROM (SELECT *,
  list_append(list_filter({_TAGS}, lambda x: x NOT IN ({_KNOWN})), CASE WHEN id % 3 = 0 THEN 'contact:missing' WHEN id % 3 = 1 THEN 'contact:linkedin-direct' ELSE 'contact:public-named' END) AS t FROM {_LEADS})""")
def contact_tags(table):
    tags = rec.with_contact_tag(rec.tag_list(F.col("tags")), F.col("id") % 3 != 0, F.col("id") % 3 == 1)
    return sample(table, "leads").select("id", _joined(tags, " | ").alias("tags"), rec.notes_field(F.col("notes"), "Website").alias("website"), pages.city(F.col("address")).alias("city"))


@_query("""SELECT event_id, strftime(ts, '%Y-%m-%d ') || CAST((hour(ts) + 11) % 12 + 1 AS STRING) || strftime(ts, ':%M ') || CASE WHEN hour(ts) >= 12 THEN 'PM' ELSE 'AM' END AS stamp, strftime(ts, 'batch-%Y%m%d-%H%M%S') AS batch,
  strftime(date_trunc('month', ts) - INTERVAL 3 MONTH + INTERVAL (day(ts) - 1) DAY, '%Y-%m-%d') AS cutoff, event_type = 'view' AND 1704067200000 - epoch_ms(ts) < 75 * 60000 AS fresh FROM events""")
def event_dates(table):
    at, day = F.col("ts").cast("timestamp"), F.to_date("ts")
    return table("events").select(
        "event_id", dates.stamp(F.col("ts")).alias("stamp"), dates.batch_id(F.col("ts"), "batch-").alias("batch"), F.date_format(dates.months_before(day, 3), "yyyy-MM-dd").alias("cutoff"),
        dates.is_fresh(F.col("event_type") == "view", F.unix_millis(at), 1704067200000).alias("fresh"),
    )


@_query(f"""SELECT count(*) AS companies, count(*) FILTER (WHERE link <> '') AS with_links, sum(coalesce(try_cast(right(phone, 2) AS BIGINT), 0)) AS total, sum(CASE WHEN isnan(balance) THEN 0 ELSE balance END) > 0 AS rich FROM {_LEADS}""")
def lead_totals(table):
    """Totals of a report; what isn't a number counts as 0."""
    number = F.coalesce(F.expr("try_cast(right(phone, 2) AS BIGINT)"), F.lit(0))
    return sample(table, "leads").agg(F.count("*").alias("companies"), F.count_if(F.col("link") != "").alias("with_links"), F.sum(number).alias("total"), (F.sum(F.nanvl("balance", F.lit(0.0))) > 0).alias("rich"))


@_query("SELECT user_id, event_id, event_type FROM (SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY 1) ORDER BY event_id DESC LIMIT 40")
def newest_entries(table):
    """The newest entries that the skip cache keeps."""
    last = table("events").groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("event_type"))
    return last.orderBy(F.desc("event_id")).limit(40)


@_query(f"""SELECT nation, CAST(floor(k / 5) AS BIGINT) AS chunk, string_agg(CAST(id AS STRING), ',' ORDER BY id) AS ids FROM (SELECT nation, id, row_number() OVER (PARTITION BY nation ORDER BY id) - 1 AS k FROM {_LEADS}) GROUP BY 1, 2""")
def contact_chunks(table):
    """The contacts of every company in batches of five."""
    ids = F.array_sort(F.collect_list("id"))
    chunks = F.transform(F.sequence(F.lit(0), F.ceil(F.size("ids") / 5).cast("int") - 1), lambda i: F.array_join(F.slice(F.col("ids"), i * 5 + 1, F.lit(5)), ","))
    return sample(table, "leads").groupBy("nation").agg(ids.alias("ids")).select("nation", F.posexplode(chunks).alias("chunk", "ids")).withColumn("chunk", F.col("chunk").cast("long"))


@_query(f"""SELECT id, company || ' (verified plant lead)' || chr(10) || chr(10) || '**manufacturing facilities (southern ontario)**' || chr(10) || CASE WHEN address = '' THEN 'No confirmed southern Ontario manufacturing plant found.'
  ELSE concat_ws(' | ', nullif(company, ''), nullif(address, ''), 'phone ' || nullif(phone, ''), nullif(website, '')) END || chr(10) || chr(10) || '**end products manufactured**' || chr(10) || says || chr(10) || chr(10) || '**major production machinery**' || chr(10)
  || 'Not confidently confirmed from public pages yet.' || chr(10) || chr(10) || '**recent hiring / expansion signals**' || chr(10) || news || chr(10) || chr(10) || '**public proof / source notes**' || chr(10) || 'No additional cited proof captured yet.' AS notes,
  'Name - ' || person || chr(10) || 'Title - ' || title || CASE WHEN link = '' THEN '' ELSE chr(10) || 'LinkedIn - ' || link END AS contact FROM {_LEADS}""")
def rendered_leads(table):
    none = F.array().cast("array<string>")
    line = rec.facility_line(F.col("company"), F.col("address"), F.col("phone"), F.lit(""), F.col("website"))
    where = F.when(F.col("address") == "", none).otherwise(F.array(line))
    leads = sample(table, "leads").withColumn("company", F.col("company"))
    return leads.select(
        "id", rec.lead_notes(F.col("company"), where, F.col("says"), none, F.array("news"), none).alias("notes"),
        rec.contact_block(F.col("person"), F.col("title"), F.col("link"), F.lit(""), F.lit("")).alias("contact"),
    )


_ANSWER = """'{"qualified": ' || CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END || ', "is_real_company": true, "is_plant_operator": ' || CASE WHEN c_custkey % 3 = 0 THEN 'null' ELSE 'true' END || ', "facility_in_range": true, "manufactures_or_processes": true, "industrial_scale": true, "confidence": "' || CASE WHEN c_custkey % 4 = 0 THEN ' HIGH' ELSE 'sure' END || '", "proof": [{"claim": " c "}, {"source_type": "x"}], "confirmed_facilities": ' || CASE WHEN c_custkey % 5 = 0 THEN '[]' ELSE '[{"name": "n"}, {"city": "x"}]' END || ', "end_products": ["", " a "], "people": [1]}' """
_MISSING = f"c_custkey % 5 = 0"
_VERDICT = f"CASE WHEN c_custkey % 3 = 0 THEN {js.quoted(v.GATE_REASONS[1])} WHEN {_MISSING} THEN {js.quoted(v.GATE_REASONS[5])} ELSE '' END"


@_query(f"""SELECT c_custkey AS id, c_custkey % 2 = 0 AND {_VERDICT} = '' AS qualified, {_VERDICT} AS reason, CASE WHEN c_custkey % 4 = 0 THEN 'high' ELSE 'low' END AS confidence, 1::INT AS proofs, CASE WHEN {_MISSING} THEN 0 ELSE 1 END::INT AS facilities, 'a' AS products FROM customer""")
def model_answers(table):
    """Answers of a model read into their closed shape."""
    customer = dealt(table("customer"), "c_custkey")
    rows = customer.sparkSession.sql(f"SELECT c_custkey AS id, {_ANSWER.replace('{', '{{').replace('}', '}}')} AS answer FROM {{customer}}", customer=customer)
    out = rows.select("id", g.read_answer(F.col("answer")).alias("a"))
    return out.select(
        "id", "a.qualified", F.col("a.reject_reason").alias("reason"), "a.confidence", F.size("a.proof").alias("proofs"), F.size("a.confirmed_facilities").alias("facilities"), _joined("a.end_products").alias("products"),
    )


@_query("""SELECT event_type, min_by(event_id, (ts, event_id)) AS first_pending FROM events WHERE event_type IN ('view', 'click', 'purchase') AND CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0 GROUP BY 1""")
def pending_commands(table):
    """The oldest open command of every kind."""
    open_ = table("events").where(F.col("event_type").isin("view", "click", "purchase") & (F.get_json_object("props", "$.k").cast("long") % 2 == 0))
    return open_.groupBy("event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first_pending"))


@_query(f"""SELECT c_custkey AS id, count(*) FILTER (WHERE own) AS activities, coalesce(max(CASE WHEN own THEN strftime(o_orderdate, '%Y-%m-%d') END), '') AS latest FROM customer LEFT JOIN
  (SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN 'contact' ELSE 'manufacturer' END = 'manufacturer' AND NOT (o_orderkey % 5 = 0) AS own FROM orders) ON c_custkey = o_custkey GROUP BY 1""")
def real_activities(table):
    kind = F.when(F.col("o_orderkey") % 7 == 0, "contact").when(F.col("o_orderkey") % 2 == 0, "manufacturer")
    by = F.when(F.col("o_orderkey") % 5 == 0, "__task__|x").otherwise("me")
    orders = table("orders").where(g.is_own_activity(kind, by)).groupBy("o_custkey").agg(F.count("*").alias("k"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("d"))
    joined = table("customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select(F.col("c_custkey").alias("id"), F.coalesce("k", F.lit(0)).alias("activities"), F.coalesce("d", F.lit("")).alias("latest"))
