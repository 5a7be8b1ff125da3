"""Readers and writers of the lead tables' files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquarry.functions import js
from sparkquarry.functions import names as n
from sparkquarry.functions import pages
from sparkquarry.sources.lenient_csv import csv_rows, header_name, read_csv  # noqa: F401

CACHE_SCHEMA = "createdAt long, query string, results array<struct<title: string, url: string, snippet: string>>"
#: The registry's headers, and what its columns are called here.
REGISTRY = {
    "Food licence number": "licence", "Legal name": "legal_name", "Address": "address", "Also doing business as": "dba", "Included establishments": "establishments",
}
#: The columns that lead tables start with.
LEAD_COLUMNS = ("company", "stage", "industry", "notes", "contacts", "tags", "last_activity")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The food-licence registry: licence, legal_name, address, dba, establishments; cleaned texts."""
    raw = read_csv(spark, path, "registry")
    found = {h: js.clean(F.col(f"`{h}`")) if h in raw.columns else F.lit("") for h in REGISTRY}
    return raw.select(*[found[h].alias(c) for h, c in REGISTRY.items()])


def read_saved_leads(spark: SparkSession, *paths: str) -> DataFrame:
    """The leads of the first of these files that exists and holds a row."""
    for path in paths:
        try:
            rows = read_csv(spark, path)
            if not rows.isEmpty():
                return rows
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
    return spark.createDataFrame([], ", ".join(f"{c} string" for c in LEAD_COLUMNS))


def write_csv(df: DataFrame, path: str, first: tuple[str, ...] = (), only: bool = False, line_end: str = "\n") -> None:
    """Columns of `first` lead, and with `only` are all; cells are quoted only where they must be."""
    order = [c for c in first if c in df.columns] + [c for c in df.columns if c not in first and not only]
    df.select(*order).write.csv(
        path, header=True, escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, lineSep=line_end
    )


def write_report(totals: DataFrame, results: DataFrame, path: str) -> None:
    """A report as JSON lines: below `path`/totals its one row of totals, below `path`/results a row for each company."""
    totals.write.json(f"{path}/totals", ignoreNullFields=False)
    results.write.json(f"{path}/results", ignoreNullFields=False)


def append_log(entries: DataFrame, path: str) -> None:
    """Entries added to a log of one JSON object a line."""
    entries.write.mode("append").json(path)


def cache_slug(query: Column) -> Column:
    return pages.slug(query)


def read_search_cache(spark: SparkSession, path: str, now_ms: int, days: int = 7) -> DataFrame:
    """Cached searches younger than `days`."""
    return spark.read.json(path, schema=CACHE_SCHEMA, multiLine=True).where(F.lit(now_ms) - F.col("createdAt") < days * 86_400_000)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log of one JSON object a line; broken lines are left out."""
    return spark.read.json(path, schema=schema, mode="DROPMALFORMED")


def sends_of_day(log: DataFrame, day: str, result: str = "sent-pending-bounce") -> DataFrame:
    """How many entries (ts, result) of that day, by the start of their time, have that result."""
    return log.where(F.col("ts").startswith(day) & (F.col("result") == result)).agg(F.count("*").alias("n"))


def sitemap_urls(xml: Column, host: str, folder: str) -> Column:
    """(url, slug) of the addresses below `host`/`folder`/slug/ that a sitemap lists, each once."""
    urls = F.array_distinct(js.every(xml, rf"<loc>(https://{re.escape(host)}/{folder}/[^/<]+/[^<]+)</loc>", 1, ""))
    part = lambda u: js.sub(js.sub(F.lower(js.first(u, rf"/{folder}/([^/]+)/", 1, "")), "[^a-z0-9-]+", ""), "-+$", "")
    return F.transform(urls, lambda u: F.struct(n.decode(u, (("&amp;", "&"),)).alias("url"), part(u).alias("slug")))


def directory_profile(html: Column, slug: Column) -> Column:
    """A maker's directory page as a profile: company, address, city, website, phone, description, categories, products."""
    from sparkquarry.functions import values as v

    plain = lambda x: js.clean(n.decode(js.sub(x, r"<[^>]+>", " "), v.ENTITIES_RESEARCH))
    block = n.first_of(js.first(html, r'<div class="row manufacturer-page-logo">([\s\S]*?)</div><div class="container">', 1), F.coalesce(html, F.lit("")))
    categories = n.distinct_in_order(F.transform(js.every(html, r'<h2 class="text-center">([\s\S]*?)</h2>', 1), plain), ignore_case=True)
    products = F.transform(js.every(html, r'<h4 class="text-dark">([\s\S]*?)</h4>', 1), lambda p: js.clean(js.sub(plain(p), r"^\S*\s", "")))

    def found(block: Column) -> Column:
        company = n.first_of(plain(js.first(block, r"<h1[^>]*>([\s\S]*?)</h1>", 1)), plain(js.first(html, r"<title[^>]*>([\s\S]*?)</title>", 1)))
        address = plain(js.sub(js.first(block, r"<address[^>]*>([\s\S]*?)</address>", 1), r"<br\s*/?>", ", ", "i"))
        website = js.clean(js.first(block, r'<p[^>]*class="[^"]*web-icon[^"]*"[\s\S]*?<a[^>]*href="([^"]+)"', 1))
        phone = plain(js.first(block, r'<p[^>]*class="[^"]*phone-icon[^"]*"[\s\S]*?<a[^>]*>([\s\S]*?)</a>', 1))
        words = n.first_of(js.first(block, r"<p>\s*<p>([\s\S]*?)</p>\s*</p>", 1), js.first(block, r"<h1[^>]*>[\s\S]*?</h1>[\s\S]*?<p>([\s\S]{20,2500}?)</p>", 1))
        text = n.first_of(plain(words), plain(js.first(html, r"""<meta[^>]+(?:name|property)=["']description["'][^>]+content=["']([^"']*)["']""", 1)))
        return F.struct(company.alias("company"), address.alias("address"), website.alias("website"), phone.alias("phone"), text.alias("description"))

    def profile(told: Column) -> Column:
        others = lambda key: F.filter(n.distinct_in_order(products, ignore_case=True), lambda p: n.census_name(p) != key)
        city = n.first_of(pages.city_of_address(told["address"]), pages.title_case(F.replace(slug, F.lit("-"), F.lit(" "))))
        return F.struct(
            told["company"].alias("company"), city.alias("city"), *[told[c].alias(c) for c in ("address", "website", "phone", "description")],
            categories.alias("categories"), F.slice(js.let(n.census_name(told["company"]), others), 1, 8).alias("products"),
        )

    return js.let(js.let(block, found), profile)


def directory_listing(listings: DataFrame, base: str) -> DataFrame:
    """(page, url, company, address) of the entries of listing pages (page, html): the anchors of one
    entry are put together, the first name and the first address of each; those without name are left out."""
    from sparkquarry.functions import search

    anchors = js.every("html", r'(href="[^"]*/bus/[^"]+"[^>]*>[\s\S]*?)</a>', 1)
    each = listings.select("page", F.posexplode(anchors).alias("at", "anchor"))
    href = n.decode(js.first("anchor", r'href="([^"]+)"', 1), (("&amp;", "&"),))
    full = js.sub(F.when(href.startswith("/"), F.concat(F.lit(base), href)).otherwise(href), r"[?#].*$", "")
    told = each.select("page", "at", full.alias("url"), search.plain(js.sub("anchor", r'^href="[^"]*"[^>]*>', "", "i")).alias("text"))
    placed = js.test("text", r"\b\d{1,6}\s+.+,\s*[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s*,\s*(?:ON|Ontario)\b")
    named = ~placed & (F.length("text") >= 3) & ~js.test("text", r"^(opening at|get directions|phone number|website|view map)$")
    address = js.trim(js.sub("text", r"\s*Get directions\s*$", "", "i"))
    first = lambda test, value: F.coalesce(F.min_by(value, F.when(test, F.col("at"))), F.lit(""))
    return told.groupBy("page", "url").agg(first(named, F.col("text")).alias("company"), first(placed, address).alias("address")).where("company <> ''")


def template(text: Column, name: Column) -> Column:
    """(name, category, subject, body) of a template: lines `key: value` between two rules, then the body."""
    raw = F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n"))
    front = F.regexp_extract(raw, r"\A---\n([\s\S]*?)\n---\n", 1)
    framed = F.regexp_like(raw, F.lit(r"\A---\n[\s\S]*?\n---\n"))
    lines = F.filter(F.split(front, "\n"), lambda x: F.contains(x, F.lit(":")))
    key = lambda x: F.lower(js.trim(js.first(x, r"^[^:]*")))

    def field(which: str) -> Column:
        of_key = F.transform(F.filter(lines, lambda x: key(x) == which), lambda x: js.trim(js.sub(x, r"^[^:]*:", "")))
        return F.coalesce(F.element_at(F.when(F.size(of_key) > 0, of_key), -1), F.lit(""))

    body = js.sub(js.sub(F.regexp_replace(raw, r"\A---\n[\s\S]*?\n---\n", ""), r"^\n+", ""), r"\s+$", "")
    return F.struct(
        n.first_of(F.when(framed, field("name")).otherwise(""), name, F.lit("(unnamed)")).alias("name"), F.when(framed, field("category")).otherwise("").alias("category"),
        F.when(framed, field("subject")).otherwise("").alias("subject"), F.when(framed, body).otherwise(js.trim(raw)).alias("body"),
    )


def read_templates(spark: SparkSession, folder: str) -> DataFrame:
    """The templates of a folder's .txt files, with their file's name."""
    files = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", "*.txt").load(folder)
    file = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1)
    return files.select(file.alias("file"), template(F.col("value"), file).alias("t")).select("file", "t.*")


def rendered(text: Column, values: Column) -> Column:
    """The text with every {{name}} replaced by its value in a map; by nothing if it has none."""
    parts = F.split(F.coalesce(text, F.lit("")), r"(?=\{\{\s*[a-zA-Z0-9_]+\s*\}\})")
    mark = r"^\{\{\s*([a-zA-Z0-9_]+)\s*\}\}"

    def filled(part: Column) -> Column:
        name = F.regexp_extract(part, mark, 1)
        value = F.coalesce(F.try_element_at(values, name), F.lit(""))
        return F.when(name == "", part).otherwise(F.concat(value, F.regexp_replace(part, mark, "")))

    return F.array_join(F.transform(parts, filled), "")


def subject(template_subject: Column, values: Column) -> Column:
    """The filled subject, else a greeting."""
    own = js.trim(rendered(template_subject, values))
    who = n.first_of(*[F.coalesce(F.try_element_at(values, F.lit(k)), F.lit("")) for k in ("first_name", "contact_name")])
    return F.when(own != "", own).otherwise(js.trim(F.concat(F.lit("Hi "), who)))
