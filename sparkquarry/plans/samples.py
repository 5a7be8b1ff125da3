"""Lead tables made of the sample tables by SQL that Spark and DuckDB both read, for queries and their SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pick(number: str, *values: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(values))
    return f"CASE ({number}) % {len(values)} {cases} END"


_FIRST = ("Maple", "Northern", "Grand River", "Lakeside", "Crystal &amp; Sons", "Heritage", "St. Clair", "Ridge & Field", "Blue Heron", "Old Mill")
_KIND = ("Foods", "Steel Fabrication", "Plastics", "Bakery", "Coffee Roasters", "Packaging", "Precast Concrete", "Pest Control", "Brewing Company", "Meat Products", "Composite Parts")
_SUFFIX = ("", " Ltd.", " Inc", " Limited", " Co.", " PLC", " - Homepage", " of Ontario")
_CITY = ("Guelph", "Hamilton", "Toronto", "Brantford", "Niagara Falls", "Oakville")
_STREET = ("Industrial Road", "Forge Street", "Mill Avenue North", "Canal Drive", "Harbour Blvd.", "Quarry Lane")
_SAYS = (
    "Operates a meat processing plant. Products include sausage and poultry.", "We manufacture precast concrete parts in our production facility.",
    "A recipe article about bread, no company name.", "Pest control for every plant, residential and commercial.", "Steel fabrication and welding, products: metal components.",
    "Handmade soap and candle boutique, one woman show.", "The brewery produces beer and cider; the plant also does bottling.", "Consulting and software services.",
    "Hot mix asphalt plant with aggregates and loadout.", "Private label packaging for food and beverage, bulk and certified.",
)
_PERSON = ("Jane", "steve", "Mike", "Anne-Marie", "Robert", "Liz", "Plant", "Joe")
_FAMILY = ("Doe", "O''Hara", "B. Smith", "van Dyke", "Team", "Miller", "Stone")
_TITLE = (
    "Plant Manager", "Head Brewer", "Sales Director", "Operations", "title not public", "Maintenance Supervisor", "Front Office", "VP Finance and Operations",
    "Owner", "QA Manager", "Retired Foreman", "staff", "",
)
_NEWS = (
    "Now hiring: millwright for our plant", "Company opens new plant after expansion", "Building permit issued in Mar 3, 2025", "Careers and employment",
    "Planning to expand, investment planned", "Production line upgrade adds capacity", "Charity award and sponsorship", "Plant closure and layoff",
    "Hiring a barista", "Approval for expansion in 2019", "Job posting: production operator, apply now", "Warehouse careers in 2026", "Newsletter and recipe",
)

LEADS = f"""SELECT c_custkey AS id, c_nationkey AS nation,
  {_pick('c_custkey * 7 + c_nationkey % 5', *_FIRST)} || ' ' || {_pick('c_custkey * 5 + c_nationkey', *_KIND)} || {_pick('c_custkey * 3 + c_nationkey', *_SUFFIX)} AS company,
  CASE WHEN c_custkey % 5 = 0 THEN '' ELSE CAST(10 + c_custkey * 13 % 290 AS STRING) || ' ' || {_pick('c_custkey * 11', *_STREET)} || ', ' || {_pick('c_custkey', *_CITY)} || ', ' || {_pick('c_custkey', 'Ontario', 'ON', 'Ontario N1K 1B8', 'QC')} END AS address,
  {_pick('c_custkey', *_CITY)} AS city,
  {_pick('c_custkey', '(519) 555-0', '+1 905.555.0', '', '416-555-0', '55-0')} || {_pick('c_custkey', '1', '2', '', '3', '4')} || {_pick('c_custkey * 3', '00', '47', '', '12', '99')} AS phone,
  {_pick('c_custkey', 'https://www.maple', 'Ridge', '', 'https://linkedin.com/company/x', 'call us; http://WWW.crystal')} || {_pick('c_custkey', 'foods.example.com/about?x=1', 'field.example.ca', '', '', 'sons.example.org:80/a b')} AS website,
  {_pick('c_custkey * 3 + 1', *_SAYS)} AS says,
  {_pick('c_custkey * 7', *_PERSON)} || ' ' || {_pick('c_custkey * 3', *_FAMILY)} AS person,
  {_pick('c_custkey * 5 + c_nationkey', *_TITLE)} AS title,
  CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN 'https://www.linkedin.com/in/p-' || CAST(c_custkey % 40 AS STRING) || '/?trk=a#b' ELSE 'https://people.example.com/' || CAST(c_custkey AS STRING) END AS link,
  {_pick('c_custkey * 9 + c_nationkey', *_NEWS)} AS news,
  {_pick('c_custkey', 'https://www.maplefoods.example.com/news', 'https://jobs.indeed.com/cmp/x', 'https://linkedin.com/company/y', 'https://paper.example.com/a', '')} AS news_url,
  {_pick('c_custkey * 3', 'Prospect', 'Ready for Outreach', ' Plant Verified - Needs Products ', 'Closed lost', '')} AS stage,
  {_pick('c_custkey', 'Address', 'address')} || ': 1 Road' || chr(10) || 'Website:  maple.example.com' || chr(10) || chr(10) || '**end products manufactured**' || chr(10) ||
    {_pick('c_custkey * 3', 'bread, cake', 'Not confidently confirmed from public pages yet.', '')} || {_pick('c_custkey', '', chr(39) + ' || chr(10) || chr(10) || ' + chr(39) + '**public proof**' + chr(39) + ' || chr(10) || ' + chr(39) + 'x', ' No verified southern Ontario manufacturing site.')} AS notes,
  {_pick('c_custkey', '', 'Name - Jane Doe', 'No named maintenance / operations / plant contact found yet after search')} AS contacts,
  {_pick('c_custkey', 'a | b |a', '', 'contact:public-named|x', ' __finder_skip | y', 'contact:linkedin-direct, z')} AS tags,
  {_pick('c_custkey', '2024-05-31', '', '2024-5-1', 'n/a')} AS last_contact, c_acctbal AS balance
FROM {{customer}}"""

SAMPLES = {"leads": (LEADS, ("customer",))}
_KEYS = {"customer": "c_custkey"}


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt to as many tasks as a shuffle has: a narrow table is one file that one task reads, and what is done with each of its rows takes long."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def sample(table, name: str) -> DataFrame:
    """The sample table, by Spark. Its values are made once, after its rows are dealt: what reads them, filters too, doesn't make them anew."""
    text, sources = SAMPLES[name]
    frames = {s: dealt(table(s), _KEYS[s]) for s in sources}
    made = frames[sources[0]].sparkSession.sql(text, **frames)
    return made.select(F.inline(F.array(F.struct(*made.columns))))


def sql(name: str) -> str:
    """The sample table as a subquery of DuckDB."""
    text, sources = SAMPLES[name]
    return "(" + text.format(**{s: s for s in sources}) + ")"
