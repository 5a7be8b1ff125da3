"""Queries on pages, search results and matches of companies; each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkquarry.functions import contacts as c
from sparkquarry.functions import js, pages, search
from sparkquarry.functions import names as n
from sparkquarry.functions import values as v
from sparkquarry.operators import greedy, records
from sparkquarry.plans.catalogue import _query
from sparkquarry.plans.company import _PROFILE, _WHAT, _address, _company, _decoded, _digits, _domain, _key, _person, _tokens
from sparkquarry.plans.samples import sample, sql
from sparkquarry.sources import files
from sparkquarry.stored import worked_out

_LEADS = sql("leads")
_T, _S, _F, _E = js.sql_test, js.sql_sub, js.sql_first, js.sql_clean
_joined = lambda col, by="; ": F.array_join(col, by)


def _entities(x: str) -> str:
    for pattern, to in v.ENTITIES:
        x = _S(x, pattern, to, "i")
    return x


def _lined(x: str) -> str:
    x = _S(_S(_S(x, r"<script[\s\S]*?</script>", " ", "i"), r"<style[\s\S]*?</style>", " ", "i"), "<[^>]+>", "\n")
    for entity, to in (("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'")):
        x = _S(x, entity, to, "i")
    return js.sql_trim(_S(_S(_S(x, r"\n{2,}", "\n"), r"\s+\.$", ""), r"\s+\.$", ""))


def _named(x: str) -> str:
    x = _S(_S(_entities(x), r"\s+", " "), r"\b(home|welcome|contact us|about us)\b", "", "i")
    x = _S(x, r"\s+[|:]\s+.*", "")
    return js.sql_trim(_S(x, r"\s+[–-]\s+(local .*|making .* possible|over [0-9]+.*|company .*|our story.*|who we are.*)$", "", "i"))


def _uniq(x: str) -> str:
    return f"list_filter({x}, lambda u, i: u <> '' AND list_position({x}, u) = i)"


_LINES = f"list_filter(list_transform(string_split(t, chr(10)), lambda l: {js.sql_trim('l')}), lambda l: l <> '')"
_ADDRESS = r"\b\d{1,6}\s+[A-Za-z0-9.'#&,\-/ ]{4,160}\b"


def _clean_address(x: str) -> str:
    x = _S(_S(x, r"\s+", " "), r"\s+,", ",")
    for start in v.ADDRESS_START:
        x = _S(x, start, "", "i")
    return js.sql_trim(x)


_IS_ADDRESS = f"""(length(a) BETWEEN 14 AND 220 AND NOT {_T('lower(a)', v.ADDRESS_OFFICE, '')} AND {_T('a', _ADDRESS)} AND ({_T('a', r'(?:^|[^A-Za-z0-9_])(?:Ontario|ON)(?:[^A-Za-z0-9_]|$)')} OR {_T('lower(a)', v.ADDRESS_CITY, '')})
  AND ({_T('a', v.POSTAL)} OR {_T('a', v.ADDRESS_TYPE)}))"""


@_query(f"""WITH p AS (SELECT page_id, html, {_lined('html')} AS t FROM pages), l AS (SELECT *, {_LINES} AS lines FROM p),
f AS (SELECT *, {_uniq(f"flatten(list_transform(list_filter(lines, lambda l: {_T('l', r'(?:^|[^A-Za-z0-9_])(?:fax|facsimile)(?:[^A-Za-z0-9_]|$)')} OR {_T('l', r'(?:^|[^A-Za-z0-9_])F' + chr(92) + 's*:')}), lambda l: {js.sql_every('l', v.PHONE, 0, '')}))")} AS faxes FROM l)
SELECT page_id, {_named(_lined(_F('html', r'<title[^>]*>([\s\S]*?)</title>', 1)))} AS title, {_named(_lined(_F('html', r'<h1[^>]*>([\s\S]*?)</h1>', 1)))} AS h1,
  coalesce(nullif({_entities(_F('html', 'property=["' + "'" + ']og:site_name["' + "'" + '][^>]+content=["' + "'" + ']([^"' + "'" + ']+)', 1))}, ''), {_S(_entities(_F('html', 'name=["' + "'" + ']twitter:site["' + "'" + '][^>]+content=["' + "'" + ']([^"' + "'" + ']+)', 1)), '^@', '')}) AS site_name,
  {_entities(_F('html', '<meta[^>]+name=["' + "'" + ']description["' + "'" + '][^>]+content=["' + "'" + ']([^"' + "'" + ']+)', 1))} AS description,
  len(lines) AS n_lines, len(list_filter(lines, lambda l: length(l) BETWEEN 20 AND 320)) AS n_snippets, array_to_string({_uniq(js.sql_every('t', v.EMAIL))}, '; ') AS emails, array_to_string(faxes, '; ') AS faxes,
  len(list_filter({_uniq(js.sql_every('t', v.PHONE, 0, ''))}, lambda x: NOT list_contains(list_transform(faxes, lambda y: {_S('y', '[^0-9]', '')}), {_S('x', '[^0-9]', '')}))) AS n_phones FROM f""")
def page_records(table):
    """A page's wide record: its names, lines, and what reaches its company."""
    html = F.col("html")
    # The text is made once, in a step of its own; what reads it doesn't make it anew.
    lined = table("pages").select("page_id", "html", pages.text_lines(html).alias("t")).repartition("page_id")
    return lined.select(
        "page_id", pages.title(html).alias("title"), pages.heading(html).alias("h1"), pages.site_name(html).alias("site_name"), pages.description(html).alias("description"),
        F.size(pages.own_lines(F.col("t"))).cast("long").alias("n_lines"), F.size(pages.snippets(F.col("t"))).cast("long").alias("n_snippets"), _joined(pages.emails(F.col("t"))).alias("emails"),
        _joined(pages.faxes(F.col("t"))).alias("faxes"), F.size(pages.phones(F.col("t"))).cast("long").alias("n_phones"),
    )


_PLACE = "company || chr(10) || 'Visit us' || chr(10) || replace(address, ', ', chr(10)) || chr(10) || 'Head office, ' || city || chr(10) || 'Tel ' || phone"


@_query(f"""WITH l AS (SELECT id, city, {_LINES} AS l FROM (SELECT *, {_PLACE} AS t FROM {_LEADS})), s AS (SELECT id, city, l, unnest(range(1, len(l) + 1)) AS k FROM l), w AS (SELECT id, city, l, k, unnest(range(0, least(3, len(l) - k + 1))) AS w FROM s),
a AS (SELECT id, city, k, w, {_clean_address("array_to_string(l[k:k + w], ', ')")} AS a FROM w), g AS (SELECT id, city, a, min(k * 10 + w) AS pos FROM a WHERE {_IS_ADDRESS} GROUP BY ALL)
SELECT id, string_agg(a, ' | ' ORDER BY pos) AS addresses, coalesce(min_by(a, pos) FILTER (WHERE contains(lower(a), lower(city))), min_by(a, pos)) AS best FROM g GROUP BY id""")
def page_addresses(table):
    """Addresses that stand in up to three lines, and the one that fits the city best."""
    text = F.concat_ws("\n", "company", F.lit("Visit us"), F.replace("address", F.lit(", "), F.lit("\n")), F.concat(F.lit("Head office, "), "city"), F.concat(F.lit("Tel "), "phone"))
    found = worked_out(sample(table, "leads"), a=pages.addresses(text)).where(F.size("a") > 0)
    return found.select("id", _joined("a", " | ").alias("addresses"), pages.best_address(F.col("a"), F.col("city")).alias("best"))


_LD = """'<html><script type="application/ld+json">{"@type": "WebPage", "name": "x"}</script><script type="application/ld+json">' || CASE c_custkey % 4 WHEN 0 THEN '[{"@type": ["Thing", "LocalBusiness"], "name": "A &amp; B ' || CAST(c_custkey AS STRING) || '"}]'
  WHEN 1 THEN '{"@graph": [{"@type": "Person", "name": "p"}, {"@type": "Organization", "name": "Org ' || CAST(c_custkey AS STRING) || '"}]}' WHEN 2 THEN 'not json' ELSE '{"@type": "Corporation", "name": ""}' END || '</script></html>'"""


@_query("SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'A & B ' || c_custkey WHEN 1 THEN 'Org ' || c_custkey ELSE '' END AS name FROM customer")
def linked_names(table):
    customer = table("customer")
    rows = customer.sparkSession.sql(f"SELECT c_custkey AS id, {_LD.replace('{', '{{').replace('}', '}}')} AS html FROM {{customer}}", customer=customer)
    return rows.select("id", pages.organisation(F.col("html")).alias("name"))


_RESULT_TITLE = "company || ' &amp; more'"
_BING = f"""'<li class="b_algo"><h2 class="x"><a id="1" href="' || CASE WHEN id % 3 = 0 THEN 'https://www.bing.com/ck/a?x=1&amp;u=a1' || CODED ELSE website END || '">' || {_RESULT_TITLE} || '</a></h2><div class="b_caption"><p>' || says || ' <b>in</b> ' || city || '</p></div></li><li class="b_algo"><h2><a href="https://dup.example.com/?a=' || CAST(id AS STRING) || '">Two</a></h2><p>plain</p></li><li class="b_algo"><h2><a href="https://dup.example.com/#z">Three</a></h2></li>'"""
_DUCK = f"""'<a rel="x" class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.example.com%2Fp%3Fq%3D' || CAST(id AS STRING) || '&amp;rut=1">' || {_RESULT_TITLE} || '</a><a class="result__snippet" href="x">' || says || '</a>'"""
_YAHOO = f"""'<div class="dd fst algo-sr x"><a href="https://r.search.yahoo.com/_ylt=A/RU=https%3a%2f%2fy.example.com%2f' || CAST(id AS STRING) || '/RK=2/RS=x"><h3 class="t">' || {_RESULT_TITLE} || '</h3></a><div class="compText aAbs"><p class="lh">' || says || '</p></div></li>'"""
_OF_LEADS = "SELECT id, {page} AS html FROM {{leads}}"
_SHOWN = "replace(company, '&amp;', '&') || ' & more'"


@_query(f"""SELECT id, 'bing' AS dialect, 0 AS pos, {_SHOWN} AS title, CASE WHEN id % 3 = 0 THEN 'https://b.example.com/' || id ELSE website END AS url, says || ' in ' || city AS snippet FROM {_LEADS} WHERE id % 3 = 0 OR {_T('website', '^https?://')}
UNION ALL SELECT id, 'bing', 1, 'Two', 'https://dup.example.com/?a=' || id, 'plain' FROM {_LEADS}
UNION ALL SELECT id, 'duckduckgo', 0, {_SHOWN}, 'https://a.example.com/p?q=' || id, says FROM {_LEADS} UNION ALL SELECT id, 'yahoo', 0, {_SHOWN}, 'https://y.example.com/' || id, says FROM {_LEADS}""")
def search_results(table):
    """The results on pages of three search engines, with their redirects opened."""
    leads = sample(table, "leads")
    coded = "translate(base64(encode('https://b.example.com/' || CAST(id AS STRING), 'UTF-8')), '+/=', '-_')"
    out = None
    for dialect, page in (("bing", _BING.replace("CODED", coded)), ("duckduckgo", _DUCK), ("yahoo", _YAHOO)):
        made = leads.sparkSession.sql(_OF_LEADS.format(page=page).replace("{{leads}}", "{leads}"), leads=leads)
        part = made.select("id", F.lit(dialect).alias("dialect"), F.inline(search.results(F.col("html"), dialect)))
        out = part if out is None else out.unionByName(part)
    return out.select("id", "dialect", "pos", "title", "url", "snippet")


_HOSTS = "(?:^|[.])(?:" + "|".join(h.replace(".", "[.]") for h in v.BLOCKED_HOSTS) + ")$"
_TRUSTED = "(?:^|[.])(?:" + "|".join(h.replace(".", "[.]") for h in v.TRUSTED_HOSTS) + ")$"
_HIT_URL = "CASE id % 6 WHEN 0 THEN 'https://www.maple.example.com/p' || id WHEN 1 THEN 'https://yelp.ca/biz/x' WHEN 2 THEN 'https://sub.gc.ca/a.pdf' WHEN 3 THEN 'https://www.zoominfo.com/c/x' WHEN 4 THEN 'https://plant.example.org/menu' ELSE 'https://shop.example.xyz/q' || id % 3 END"
_PLANTY = _T("h", v.FOOD_PLANT, "")
_SKIPS = " OR ".join((f"(contains(h, 'cafe') AND NOT {_PLANTY})" if w == "cafe" else f"contains(h, {js.quoted(w)})") for w in (*v.SKIP_RESULT, *v.SKIP_JOBS))
_OFFICIAL = f"""NOT ({_T('lower(url)', v.NOT_OFFICIAL[0][1], '')} OR {_T('lower(title)', v.NOT_OFFICIAL[1][1], '')} OR {_T('lower(title)', v.NOT_OFFICIAL[2][1], '')} OR ({_T('lower(snippet)', v.COMPARING[0], '')} AND {_T('lower(snippet)', v.COMPARING[1], '')})
  OR (NOT {_PLANTY} AND ({_T('lower(title)', v.EATING_TITLE, '')} OR {_T('lower(title)', v.EATING, '')} OR {_T('lower(snippet)', v.EATING, '')})))"""


def _kept_sql(hosts: str, skips: str, key: str, limit: int) -> str:
    return f"""WITH r AS (SELECT nation AS query, id AS pos, company AS title, {_HIT_URL} AS url, says AS snippet, city FROM {_LEADS}), d AS (SELECT *, lower(title || ' ' || url || ' ' || snippet) AS h, {_domain('url')} AS domain FROM r),
k AS (SELECT *, {_T('domain', _TRUSTED)} AS trusted FROM d), f AS (SELECT *, {key} AS site FROM k WHERE domain <> '' AND {hosts} AND (trusted OR NOT (({skips}) OR NOT {_OFFICIAL}))
  AND (contains(h, 'ontario') OR contains(h, 'canada') OR contains(h, 'guelph') OR (regexp_matches(domain, '[.](ca|com|net|org)$') AND ({_T('h', v.PLANT_RESULT, '')} OR trusted OR {_OFFICIAL}))))
SELECT query, pos, site, title, url FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY query, site ORDER BY pos) = 1) QUALIFY row_number() OVER (PARTITION BY query ORDER BY pos) <= {limit}"""


def _hits(table):
    leads = sample(table, "leads")
    rows = leads.sparkSession.sql(f"SELECT concat('plants in \"Guelph\" ', CAST(nation AS STRING)) AS query, nation, id AS pos, company AS title, {_HIT_URL.replace('{', '{{')} AS url, says AS snippet FROM {{leads}}", leads=leads)
    return rows.select("query", "pos", "title", "url", "snippet")


_PATH_SKIPS = _SKIPS.replace("".join(f" OR contains(h, {js.quoted(w)})" for w in v.SKIP_JOBS), " OR contains(h, 'soap')")


@_query(_kept_sql("regexp_matches(domain, '(?:^|[.])(?:example[.]com|yelp[.]ca|gc[.]ca)$')", _PATH_SKIPS, "lower(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', ''))", 4))
def search_kept_pages(table):
    """Of a few hosts every page that may tell of people, one each; a host that is blocked otherwise may be among them."""
    kept = search.kept_results(_hits(table), 4, allowed=("example.com", "yelp.ca", "gc.ca"), skip=("soap",), keep_jobs=True, keep_path=True)
    return kept.select(js.first("query", "[0-9]+$").cast("int").alias("query"), "pos", "site", "title", "url")


@_query(_kept_sql(f"NOT {_T('domain', _HOSTS)}", _SKIPS, "'site://' || domain", 2))
def search_kept(table):
    """Which results lead to companies: blocked hosts, lists, reviews and eateries are left out."""
    kept = search.kept_results(_hits(table), 2)
    return kept.select(js.first("query", "[0-9]+$").cast("int").alias("query"), "pos", "site", "title", "url")


@_query(f"""WITH m AS (SELECT page_id, 'https://made.example.com/manufacturer/' || CASE page_id % 3 WHEN 0 THEN 'Guelph-' ELSE 'st_x' END || '/' || page_id || '?a=1&amp;b=2' AS loc FROM pages)
SELECT page_id, replace(loc, '&amp;', '&') AS url, CASE page_id % 3 WHEN 0 THEN 'guelph' ELSE 'stx' END AS slug FROM m""")
def sitemap_entries(table):
    loc = F.concat(F.lit("https://made.example.com/manufacturer/"), F.when(F.col("page_id") % 3 == 0, "Guelph-").otherwise("st_x"), F.lit("/"), F.col("page_id").cast("string"), F.lit("?a=1&amp;b=2"))
    entry = F.concat(F.lit("<url><loc>"), loc, F.lit("</loc></url>"))
    xml = F.concat(F.lit("<urlset><loc>https://made.example.com/other/1</loc>"), entry, entry, F.lit("</urlset>"))
    return table("pages").select("page_id", F.inline(files.sitemap_urls(xml, "made.example.com", "manufacturer")))


@_query(f"""SELECT id, {_E(_decoded('company'))} AS company, CASE WHEN id % 2 = 0 THEN city ELSE 'Old Town' END AS city, '12 Mill St, ' || city || CASE WHEN id % 2 = 0 THEN ', Ontario' ELSE '' END AS address, website, phone, {_E('says')} AS description, 'Food; Tools' AS categories,
  'Bread; Pie' AS products FROM {_LEADS} WHERE website NOT LIKE '%;%' AND website <> ''""")
def directory_profiles(table):
    """Makers' directory pages as profiles."""
    parts = (
        '<div class="row manufacturer-page-logo"><h1 class="a">', F.col("company"), "</h1><address>12 Mill St<br/>", F.col("city"), F.when(F.col("id") % 2 == 0, "<br>Ontario").otherwise(""),
        '</address><p class="x web-icon"><a href="', F.col("website"), '">w</a></p><p class="phone-icon"><a>', F.col("phone"), "</a></p><p><p>", F.col("says"),
        '</p></p></div><div class="container"></div><h2 class="text-center">Food</h2><h2 class="text-center">food </h2><h2 class="text-center">Tools</h2>',
        '<h4 class="text-dark">1. Bread</h4><h4 class="text-dark">2. Pie</h4><h4 class="text-dark">3. BREAD</h4><h4 class="text-dark">4. ', F.col("company"), "</h4>",
    )
    html = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    rows = sample(table, "leads").where("website NOT LIKE '%;%' AND website <> ''").select("id", html.alias("html"))
    rows = worked_out(worked_out(rows, page=F.col("html")), p=files.directory_profile(F.col("page"), F.lit("old-town")))
    return rows.select("id", "p.company", "p.city", "p.address", "p.website", "p.phone", "p.description", _joined("p.categories").alias("categories"), _joined("p.products").alias("products"))


@_query(f"""SELECT nation, 'https://list.example.com/bus/' || id AS url, replace(company, '&amp;', '&') AS company, CASE WHEN address LIKE '%, ON%' OR address LIKE '%, Ontario%' THEN address ELSE '' END AS address FROM {_LEADS}""")
def directory_listings(table):
    """The entries of a directory's listing page: name and address stand in two links."""
    anchor = lambda text: F.concat(F.lit('<a href="/bus/'), F.col("id").cast("string"), F.lit('?x=1" class="l">'), text, F.lit("</a>"))
    placed = F.when(F.col("address").contains(", ON") | F.col("address").contains(", Ontario"), F.concat("address", F.lit(" Get directions"))).otherwise("View map")
    html = F.concat(anchor(F.lit("Website")), anchor(placed), anchor(F.concat(F.lit("<b>"), "company", F.lit("</b>"))))
    page = sample(table, "leads").groupBy("nation").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", html.alias("h")))), lambda x: x["h"]), "\n").alias("html"))
    return files.directory_listing(page.withColumnRenamed("nation", "page"), "https://list.example.com").withColumnRenamed("page", "nation")


_BODY = "'Dear {{ first_name }}, {{company}}{{missing}} in {{city }}.'"


@_query(f"""SELECT id, CASE WHEN id % 2 = 0 THEN 'About ' || company ELSE 'Hi' || rtrim(' ' || {_F('person', r'^[^ ]+')}) END AS subject, 'Dear ' || {_F('person', r'^[^ ]+')} || ', ' || company || ' in ' || city || '.' AS body FROM {_LEADS}""")
def rendered_templates(table):
    """A template with front matter, read and filled for every lead."""
    raw = F.concat(F.lit("---\r\nName: intro\r\nsubject: "), F.when(F.col("id") % 2 == 0, "About {{company}}").otherwise(""), F.lit("\r\n---\r\n\r\n" + _BODY[1:-1] + "\r\n\r\n"))
    values = F.create_map(F.lit("first_name"), js.first("person", r"^[^ ]+"), F.lit("company"), F.col("company"), F.lit("city"), F.col("city"))
    told = sample(table, "leads").select("id", files.template(raw, F.lit("a.txt")).alias("t"), values.alias("v"))
    return told.select("id", files.subject(F.col("t.subject"), F.col("v")).alias("subject"), files.rendered(F.col("t.body"), F.col("v")).alias("body"))


_HOSTED = f"list_transform({js.sql_every('text', v.MAIL_URL, 1)}, lambda r: {{'raw': r, 'host': {_domain(_S('r', '[),.;]+$', ''))}}})"
_FITS = "list_sum(list_transform(w, lambda t: CASE WHEN contains(x.own, t) OR contains(t, x.own) THEN CASE WHEN length(t) >= 6 THEN 10 ELSE 6 END ELSE 0 END))"
_POINTS = f"{_FITS} - CASE WHEN {_T('x.host', v.DIRECTORY_HOST)} THEN 20 ELSE 0 END - CASE WHEN {_T('x.raw', chr(92) + 'b(?:careers|jobs|hiring)' + chr(92) + 'b')} THEN 5 ELSE 0 END"


@_query(f"""WITH t AS (SELECT id, list_filter({_tokens('company')}, lambda w: length(w) >= 4) AS w, concat_ws(' ', website, 'https://careers.' || replace({_company('company')}, ' ', '') || '.com/jobs', 'see www.zoominfo.com/' || id, 'mail.google.com') AS text FROM {_LEADS}),
u AS (SELECT id, w, list_filter({_HOSTED}, lambda x: x.host <> '' AND NOT {_T('x.host', v.SOCIAL_HOST)}) AS h FROM t),
o AS (SELECT id, w, list_transform(list_filter(h, lambda x, i: list_position(list_transform(h, lambda y: y.host), x.host) = i), lambda x, i: {{'raw': x.raw, 'host': x.host, 'at': i, 'own': {_S(_S('x.host', '[.](?:com|ca|net|org|co|us|io)$', '', 'i'), '[^a-z0-9]', '', 'i')}}}) AS h FROM u),
s AS (SELECT id, list_transform(h, lambda x: {{'rank': -({_POINTS}), 'size': length(x.host), 'at': x.at, 'host': x.host}}) AS s FROM o)
SELECT id, coalesce(list_sort(list_filter(s, lambda x: x.rank < 0))[1].host, '') AS host FROM s""")
def mail_domains(table):
    """The host among a lead's links that fits its name."""
    key = n.company_key("company")
    words = F.filter(n.company_tokens("company"), lambda w: F.length(w) >= 4)
    careers = F.concat(F.lit("https://careers."), F.replace(key, F.lit(" "), F.lit("")), F.lit(".com/jobs"))
    text = F.concat_ws(" ", "website", careers, F.concat(F.lit("see www.zoominfo.com/"), F.col("id").cast("string")), F.lit("mail.google.com"))
    return sample(table, "leads").select("id", search.mail_domain(words, text).alias("host"))


def _tri(x: str) -> str:
    return f"list_distinct(list_filter(string_split({_key(_decoded(x), v.CENSUS_WORDS)}, ' '), lambda w: length(w) >= 3))"


_SIM = "len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))"


@_query(f"""WITH l AS (SELECT id AS pos, {_key(_decoded('company'), v.CENSUS_WORDS)} AS k, {_domain('website')} AS h, {_tri('company')} AS w FROM {_LEADS}), a AS (SELECT * FROM l WHERE pos % 3 = 0), b AS (SELECT * FROM l WHERE pos % 3 <> 0)
SELECT a.pos, min(b.pos) AS known_pos FROM a, b WHERE (a.k <> '' AND a.k = b.k) OR (a.h <> '' AND a.h = b.h AND contains(a.h, 'www')) OR (length(a.k) > 8 AND length(b.k) > 8 AND (contains(a.k, b.k) OR contains(b.k, a.k)))
  OR (len(a.w) >= 2 AND len(b.w) > 0 AND {_SIM} >= 0.82) GROUP BY 1""")
def known_companies(table):
    """The first known company that each lead is the same as."""
    host = F.when(F.contains(n.domain_key("website"), F.lit("www")), n.domain_key("website")).otherwise("")
    rows = sample(table, "leads").select(F.col("id").alias("pos"), n.census_name("company").alias("key"), host.alias("host"), n.census_tokens("company").alias("words"), F.array().cast("array<string>").alias("aliases"))
    return greedy.first_known(rows.where("pos % 3 = 0"), rows.where("pos % 3 <> 0").drop("aliases"))


@_query(f"""WITH l AS (SELECT id AS pos, nation % 3 AS nation, lower(person) AS name, lower(title) AS title, CASE WHEN contains(link, 'linkedin') THEN link ELSE '' END AS link FROM {_LEADS})
SELECT a.pos AS next_pos, min(b.pos) AS existing_pos FROM l a JOIN l b ON a.nation = b.nation WHERE a.pos % 5 < 2 AND b.pos % 5 >= 2 AND ((a.link <> '' AND a.link = b.link) OR (a.name = b.name AND (a.title = b.title OR b.title = '' OR {_T('b.title', v.WEAK_TITLE)}))) GROUP BY 1""")
def existing_contacts(table):
    link = F.when(F.contains("link", F.lit("linkedin")), F.col("link")).otherwise("")
    rows = sample(table, "leads").select(F.col("id").alias("pos"), (F.col("nation") % 3).alias("group"), F.lower("person").alias("name"), F.lower("title").alias("title"), link.alias("link"))
    return greedy.first_existing(rows.where("pos % 5 < 2"), rows.where("pos % 5 >= 2"), c.is_weak_title)


_LOOSE = "list_filter({0}, lambda w: w NOT IN ('com', 'ca', 'www'))"


@_query(f"""WITH l AS (SELECT id, company, {_company('company')} AS k, list_distinct({_LOOSE.format(_tokens('company'))}) AS w FROM {_LEADS}),
p AS (SELECT a.id, b.id AS known_id, contains(lower(b.company), lower(a.company)) AS c, a.k = b.k AS e, len(a.w) >= 2 AND len(b.w) >= 2 AND (len(list_filter(a.w, lambda x: NOT list_contains(b.w, x))) = 0 OR len(list_filter(b.w, lambda x: NOT list_contains(a.w, x))) = 0) AS s
  FROM l a, l b WHERE a.id % 3 = 0 AND b.id % 3 <> 0 AND a.k <> '' AND b.k <> ''),
r AS (SELECT id, known_id, CASE WHEN e AND c THEN 0 WHEN s AND c THEN 1 WHEN c THEN 2 WHEN e THEN 3 WHEN s THEN 4 END AS rank FROM p) SELECT id, min_by(known_id, rank * 1000000 + known_id) AS known_id FROM r WHERE rank IS NOT NULL GROUP BY id""")
def company_lookup(table):
    """The known company that a name asks for: equal, loosely equal, or holding it."""
    rows = sample(table, "leads").select("id", "company")
    return greedy.looked_up(rows.where("id % 3 = 0"), rows.where("id % 3 <> 0"))


_NEW = "list_filter([CASE WHEN name <> '' THEN 'n' || name END, CASE WHEN address <> '' THEN 'a' || address END, CASE WHEN domain <> '' THEN 'd' || domain END, CASE WHEN phone <> '' THEN 'p' || phone END], lambda x: x IS NOT NULL)"
_HELD = lambda kind, col: f"({col} <> '' AND (list_contains(seen, '{kind}' || {col}) OR list_contains(old, '{kind}' || {col})))"


@_query(f"""WITH RECURSIVE l AS (SELECT id, {_key('company', v.LEGAL)} AS name, {_address('address')} AS address, {_domain('website')} AS domain, CASE WHEN length({_digits('phone')}) < 10 THEN '' ELSE right({_digits('phone')}, 10) END AS phone FROM {_LEADS}),
r AS (SELECT row_number() OVER (ORDER BY id) AS i, * FROM l WHERE id % 4 <> 0), o AS (SELECT list('n' || name) FILTER (WHERE name <> '') || list('a' || address) FILTER (WHERE address <> '') AS old, list(name) FILTER (WHERE id % 24 = 0 AND name <> '') AS hard FROM l WHERE id % 4 = 0),
w AS (SELECT 0::BIGINT AS z, []::VARCHAR[] AS seen, []::BIGINT[] AS ids UNION ALL SELECT i, CASE WHEN dup THEN seen ELSE list_concat(seen, new) END, CASE WHEN dup THEN ids ELSE list_append(ids, id) END FROM (SELECT r.i, r.id, w.seen, w.ids, {_NEW} AS new,
  coalesce(list_contains(hard, name), false) OR {_HELD('a', 'address')} OR (address = '' AND ({_HELD('n', 'name')} OR {_HELD('p', 'phone')})) OR (name <> '' AND domain <> '' AND list_contains(seen, 'n' || name) AND list_contains(seen, 'd' || domain)) AS dup
  FROM w JOIN r ON r.i = w.z + 1, o)) SELECT id AS pos, name, address, domain, phone, list_contains((SELECT ids FROM w ORDER BY z DESC LIMIT 1), id) AS accepted FROM r""")
def accepted_leads(table):
    """Leads in order, without duplicates of known companies or of leads accepted before."""
    leads = sample(table, "leads").where("id % 4 <> 0")
    keys = leads.select(F.col("id").alias("pos"), n.dedupe_name("company").alias("name"), n.address_key("address").alias("address"), n.domain_key("website").alias("domain"), n.phone_key("phone").alias("phone"))
    old = sample(table, "leads").where("id % 4 = 0")
    each = F.explode(F.array(F.struct(F.lit("name").alias("kind"), n.dedupe_name("company").alias("key")), F.struct(F.lit("address").alias("kind"), n.address_key("address").alias("key"))))
    known = old.select(each.alias("k"), (F.col("id") % 24 == 0).alias("skip")).select("k.*", "skip")
    return greedy.without_duplicates(keys, known)


_SCORE = f"""30 * CAST(p <> '' AS INT) + 8 * CAST(link <> '' AS INT) + 20 * CAST({_T(_WHAT, v.STRONG_ROLE)} AS INT) + 8 * CAST({_T(_WHAT, v.SCORED_ROLE)} AS INT) - 30 * CAST({_T(_WHAT, v.WEAK_TITLE)} AS INT) - 8 * CAST({_T(_WHAT, v.DIRECTORY_TITLE)} AS INT)"""


@_query(f"""WITH RECURSIVE s AS (SELECT id, person, title, p AS link, {_person('person')} AS k, {_SCORE} AS score FROM (SELECT *, {_PROFILE} AS p FROM {_LEADS}) WHERE title <> ''), r AS (SELECT row_number() OVER (ORDER BY score DESC, id) AS i, * FROM s),
w AS (SELECT 0::BIGINT AS z, []::VARCHAR[] AS seen, []::BIGINT[] AS ids UNION ALL SELECT r.i, CASE WHEN list_contains(seen, k) OR list_contains(seen, r.link) THEN seen ELSE list_concat(seen, CASE WHEN r.link = '' THEN [k] ELSE [k, r.link] END) END,
  CASE WHEN list_contains(seen, k) OR list_contains(seen, r.link) THEN ids ELSE list_append(ids, r.id) END FROM w JOIN r ON r.i = w.z + 1)
SELECT id, person, title, link, score FROM r WHERE list_contains((SELECT ids FROM w ORDER BY z DESC LIMIT 1), id)""")
def distinct_contacts(table):
    """Contacts in order of score, none with the name or link of one before."""
    link = c.linkedin_url(F.col("link"))
    scored = sample(table, "leads").where("person <> '' AND title <> ''").select("id", "person", "title", link.alias("link"), c.contact_score(F.col("title"), F.col("link"), F.col("link"), F.lit("")).alias("score"))
    # The order of the walk: no row number over all rows, but score and id in one number.
    rows = scored.withColumn("pos", (F.lit(1000) - F.col("score")) * 2**40 + F.col("id"))
    kept = greedy.distinct_by_any_key(rows, "pos", {"name": n.person_key("person"), "link": F.col("link")})
    return kept.select("id", "person", "title", "link", "score")


@_query(f"""WITH RECURSIVE s AS (SELECT nation AS g, id, person, title, link, news, CASE WHEN contains(lower(link), 'linkedin.com/in/') THEN regexp_replace(lower(link), '/+$', '') ELSE '' END AS l,
  trim(regexp_replace(lower(person), '[^a-z0-9]+', ' ', 'g')) AS m FROM {_LEADS} WHERE person <> '' AND title <> ''), r AS (SELECT row_number() OVER (ORDER BY id) AS i, * FROM s),
w AS (SELECT 0::BIGINT AS z, []::STRUCT(g INT, l VARCHAR, m VARCHAR, id BIGINT)[] AS heads, 0::BIGINT AS home UNION ALL
  SELECT i, CASE WHEN home IS NULL THEN list_append(heads, {{'g': g, 'l': l, 'm': m, 'id': id}}) ELSE heads END, coalesce(home, id) FROM (SELECT r.*, w.heads,
    coalesce(list_filter(heads, lambda x: x.g = r.g AND r.l <> '' AND x.l = r.l)[1].id, list_filter(heads, lambda x: x.g = r.g AND x.m = r.m)[1].id) AS home FROM w JOIN r ON r.i = w.z + 1)),
h AS (SELECT w.home, r.* FROM w JOIN r ON r.i = w.z)
SELECT g AS "group", home AS pos, min_by(person, id) AS name, coalesce(min_by(title, id) FILTER (WHERE NOT {_T('title', v.REPLACED_TITLE)}), max_by(title, id)) AS title, coalesce(min_by(link, id) FILTER (WHERE link <> ''), '') AS link, '' AS source,
  coalesce(min_by(news, id) FILTER (WHERE news <> ''), '') AS notes FROM h GROUP BY g, home""")
def merged_people(table):
    """The contacts of every company put together by link or name."""
    rows = sample(table, "leads").select(F.col("nation").alias("group"), F.col("id").alias("pos"), F.col("person").alias("name"), "title", "link", F.lit("").alias("source"), F.col("news").alias("notes"))
    return greedy.merged_contacts(rows, lambda t: js.test(t, v.REPLACED_TITLE))


_JOINED = lambda col, k: f"""(SELECT home, string_agg(v, '|' ORDER BY id) AS {col} FROM (SELECT *, row_number() OVER (PARTITION BY home ORDER BY id) AS place FROM (
  SELECT home, min_by(v, id) AS v, min(id) AS id FROM (SELECT home, id, {js.sql_clean(col)} AS v FROM h) WHERE v <> '' GROUP BY home, lower(v))) WHERE place <= {k} GROUP BY home)"""  # noqa: E731


@_query(f"""WITH RECURSIVE l AS (SELECT id, says, city, news, {_key(_decoded('company'), v.CENSUS_WORDS)} AS k, {_domain('website')} AS h, {_tri('company')} AS w FROM {_LEADS}), r AS (SELECT row_number() OVER (ORDER BY id) AS i, * FROM l),
w AS (SELECT 0::BIGINT AS z, []::STRUCT(id BIGINT, k VARCHAR, h VARCHAR, w VARCHAR[])[] AS heads, 0::BIGINT AS home UNION ALL
  SELECT i, CASE WHEN home IS NULL THEN list_append(heads, {{'id': id, 'k': k, 'h': h, 'w': w}}) ELSE heads END, coalesce(home, id) FROM (SELECT r.*, w.heads, list_filter(heads, lambda x: (r.k <> '' AND x.k = r.k) OR (r.h <> '' AND x.h = r.h)
    OR (length(r.k) > 10 AND length(x.k) > 10 AND (contains(r.k, x.k) OR contains(x.k, r.k))) OR (len(r.w) > 0 AND len(list_intersect(r.w, x.w)) / (len(r.w) + len(x.w) - len(list_intersect(r.w, x.w))) >= 0.86))[1].id AS home FROM w JOIN r ON r.i = w.z + 1)),
h AS (SELECT w.home, r.* FROM w JOIN r ON r.i = w.z)
SELECT home AS pos, key, members, coalesce(says, '') AS products, coalesce(city, '') AS categories, coalesce(news, '') AS reasons, score FROM (SELECT home, min_by(k, id) AS key, count(*) AS members, max(id % 50) AS score FROM h GROUP BY home)
  LEFT JOIN {_JOINED('says', 12)} USING (home) LEFT JOIN {_JOINED('city', 8)} USING (home) LEFT JOIN {_JOINED('news', 1000000)} USING (home)""")
def merged_companies(table):
    """Profiles put together by host, name or likeness of their names."""
    rows = sample(table, "leads").select(
        F.col("id").alias("pos"), n.census_name("company").alias("key"), n.domain_key("website").alias("host"), n.census_tokens("company").alias("words"), F.array("says").alias("products"),
        F.array("city").alias("categories"), F.array("news").alias("reasons"), (F.col("id") % 50).alias("score"),
    )
    merged = greedy.merged_profiles(rows)
    return merged.select("pos", "key", "members", *[F.array_join(c, "|").alias(c) for c in ("products", "categories", "reasons")], "score")


_OLD = "chr(10) || chr(10) || '**Recent signals / changes / hiring?**' || chr(10) || 'old' || chr(10) || 'news' || chr(10) || chr(10) || '**proof**' || chr(10) || 'x'"
_NOTES = f"notes || CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN {_OLD} ELSE chr(10) || '**recent hiring / expansion signals**' || chr(10) || 'last' END"
_SECTION = r"(?i)(?:\n\n)?\*\*(?:recent hiring / expansion signals|recent signals / changes / hiring\?)\*\*\s*[\s\S]*?(\n\n\*\*|$)"


@_query(f"""SELECT id, CASE WHEN regexp_matches(n, '{_SECTION}') THEN {js.sql_trim("regexp_replace(n, '" + _SECTION + "', chr(10) || chr(10) || '**recent hiring / expansion signals**' || chr(10) || news || '" + chr(92) + "1')")}
  ELSE n || chr(10) || chr(10) || '**recent hiring / expansion signals**' || chr(10) || news END AS notes FROM (SELECT id, news, {js.sql_trim(_NOTES)} AS n FROM {_LEADS})""")
def noted_signals(table):
    """Notes with their section on signals written anew, or added."""
    leads = sample(table, "leads")
    rows = leads.sparkSession.sql(f"SELECT id, news, {_NOTES} AS notes FROM {{leads}}", leads=leads)
    known = ("recent signals / changes / hiring?",)
    return rows.select("id", records.with_section(F.col("notes"), "recent hiring / expansion signals", F.col("news"), known).alias("notes"))
