"""Search-result pages: their results, the addresses behind redirects, and which results to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkquarry.functions import js
from sparkquarry.functions import names as n
from sparkquarry.functions import values as v

#: Per dialect: what a block starts with, how far it goes, where in it address, title and snippet are.
DIALECTS = {
    "duckduckgo": (
        r'<a[^>]+class="[^"]*result__a', None, (r'<a[^>]+class="[^"]*result__a[^"]*"[^>]+href="([^"]+)"[^>]*>([\s\S]*?)</a>',),
        (r'class="[^"]*result__snippet[^"]*"[^>]*>([\s\S]*?)</(?:a|div)>',),
    ),
    "bing": (
        r'<li class="b_algo"', "</li>", (r'<h2[^>]*><a[^>]+href="([^"]+)"[^>]*>([\s\S]*?)</a>',),
        (r'<div class="b_caption"[\s\S]*?<p>([\s\S]*?)</p>', r"<p>([\s\S]*?)</p>"),
    ),
    "yahoo": (
        r'<div class="dd[^"]*algo-sr', "</li>",
        (r'<a[^>]+href="([^"]+)"[^>]*>[\s\S]*?<h3[^>]*>([\s\S]*?)</h3>', r'<h3[^>]*>[\s\S]*?<a[^>]+href="([^"]+)"[^>]*>([\s\S]*?)</a>'),
        (r'<div class="compText[^"]*"[\s\S]*?<p[^>]*>([\s\S]*?)</p>', r"<p[^>]*>([\s\S]*?)</p>"),
    ),
}
NEARBY = 1600  # characters from a result's start in which its snippet is looked for where nothing ends a block


def plain(html: Column) -> Column:
    """The text between tags, runs of blanks as one, entities decoded."""
    return js.trim(n.decode(js.sub(js.sub(html, r"<[^>]+>", " "), r"\s+", " "), v.ENTITIES_SEARCH))


def parameter(url: Column, name: str) -> Column:
    """The decoded value of a query parameter; null if there is none."""
    return F.try_url_decode(F.nullif(js.first(url, rf"[?&]{name}=([^&#]*)", 1, ""), F.lit("")))


def unwrap(url: Column, dialect: str) -> Column:
    """The address that a result page's link leads to; empty if a redirect hides none."""
    host = n.domain_key(url)
    path = js.sub(js.sub(url, r"^https?://[^/?#]*", "", "i"), r"[?#].*$", "")
    if dialect == "duckduckgo":
        full = F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).when(url.startswith("/"), F.concat(F.lit("https://duckduckgo.com"), url)).otherwise(url)
        at = js.sub(js.sub(full, r"^https?://[^/?#]*", "", "i"), r"[?#].*$", "")
        return F.when(n.domain_key(full).endswith("duckduckgo.com") & at.startswith("/l/"), F.coalesce(parameter(full, "uddg"), F.lit(""))).otherwise(full)
    if dialect == "bing":
        coded = js.sub(F.coalesce(parameter(url, "u"), F.lit("")), r"^a\d", "", "i")
        padded = F.rpad(F.translate(coded, "-_", "+/"), (F.ceil(F.length(coded) / 4) * 4).cast("int"), F.lit("="))
        opened = F.coalesce(F.decode(F.try_to_binary(padded, F.lit("base64")), "UTF-8"), F.lit(""))
        return F.when(host.endswith("bing.com") & (path == "/ck/a"), opened).otherwise(url)
    inside = js.first(path, r"/RU=([^/]+)/RK=", 1)
    direct = F.when(inside != "", F.try_url_decode(inside))
    return F.coalesce(direct, parameter(url, "RU"), parameter(url, "ru"), url)


def results(html: Column, dialect: str) -> Column:
    """(pos, title, url, snippet) of a page's results, the first of each address without query and fragment."""
    start, end, links, snippets = DIALECTS[dialect]
    pieces = F.split(F.coalesce(html, F.lit("")), rf"(?i)(?={js.java(start)})", -1)
    blocks = F.filter(pieces, lambda b: js.test(b, "^" + start))
    cut = (lambda b: F.left(b, F.lit(NEARBY))) if end is None else (lambda b: js.first(b, rf"^[\s\S]*?{end}"))
    blocks = F.transform(blocks, cut)

    def result(block: Column, at: Column) -> Column:
        pick = lambda patterns, group: n.first_of(*[js.first(block, p, group) for p in patterns])
        which = [js.test(block, p) for p in links]
        raw = F.coalesce(*[F.when(w, js.first(block, p, 1)) for w, p in zip(which, links)], F.lit(""))
        name = F.coalesce(*[F.when(w, js.first(block, p, 2)) for w, p in zip(which, links)], F.lit(""))
        address = js.let(n.decode(raw, v.ENTITIES_SEARCH), lambda url: unwrap(url, dialect))
        return F.struct(at.alias("pos"), plain(name).alias("title"), address.alias("url"), plain(pick(snippets, 1)).alias("snippet"))

    found = F.filter(F.transform(blocks, result), lambda r: js.test(r["url"], "^https?://"))
    once = lambda rows, keys: F.filter(rows, lambda r, i: F.array_position(keys, F.get(keys, i)) == i + 1)
    return js.let(found, lambda rows: js.let(F.transform(rows, lambda r: js.sub(r["url"], r"[?#].*$", "")), lambda keys: once(rows, keys)))


def below(host: Column, hosts: tuple[str, ...]) -> Column:
    """Is it one of the hosts, or a part of one?"""
    return js.test(host, r"(?:^|\.)(?:" + "|".join(h.replace(".", r"\.") for h in hosts) + ")$")


def is_trusted(url: Column) -> Column:
    return below(n.domain_key(url), v.TRUSTED_HOSTS) | js.test(url, r"^https?://(?:www\.)?linkedin\.com(?:[/?#]|$)")


def is_official(title: Column, snippet: Column, url: Column) -> Column:
    """Does a result look like a company's own page?"""
    part = {"title": F.lower(title), "snippet": F.lower(snippet), "url": F.lower(url)}
    plant = js.test(F.concat_ws(" ", *part.values()), v.FOOD_PLANT, "")
    bad = js.test(part["snippet"], v.COMPARING[0], "") & js.test(part["snippet"], v.COMPARING[1], "")
    for name, pattern in v.NOT_OFFICIAL:
        bad = bad | js.test(part[name], pattern, "")
    eating = js.test(part["title"], v.EATING_TITLE, "") | js.test(part["title"], v.EATING, "") | js.test(part["snippet"], v.EATING, "")
    return is_trusted(url) | ~(bad | (~plant & eating))


def is_skipped(title: Column, snippet: Column, url: Column, more: tuple[str, ...] = (), keep_jobs: bool = False) -> Column:
    """Is a result a list, a review, an eatery or the like? `more` has other words to leave out, in small letters."""
    hay = F.lower(F.concat_ws(" ", title, url, snippet))
    plant, found = js.test(hay, v.FOOD_PLANT, ""), F.lit(False)
    for words in (*v.SKIP_RESULT, *(() if keep_jobs else v.SKIP_JOBS), *more):
        hit = F.contains(hay, F.lit(words))
        found = found | (hit & ~plant if words == "cafe" else hit)
    return ~is_trusted(url) & (found | ~is_official(title, snippet, url))


def is_local(title: Column, snippet: Column, url: Column, query: Column, host: Column) -> Column:
    """Does a result have to do with the searched place or with plants?"""
    hay = F.lower(F.concat_ws(" ", title, snippet, url))
    named = F.transform(js.every(query, '"([^"]+)"', 1), F.lower)
    local = F.contains(hay, F.lit("ontario")) | F.contains(hay, F.lit("canada")) | F.exists(F.slice(named, 1, 2), lambda x: F.contains(hay, x))
    usual = js.test(host, r"\.(?:ca|com|net|org)$")
    return below(host, ("linkedin.com",)) | (usual & (local | js.test(hay, v.PLANT_RESULT, "") | is_official(title, snippet, url))) | (~usual & local)


def kept_results(
    found: DataFrame, limit: int = 8, allowed: tuple[str, ...] = (), allow_blocked: bool = False, skip: tuple[str, ...] = (), keep_jobs: bool = False, keep_path: bool = False
) -> DataFrame:
    """The results (query, pos, title, url, snippet) that lead to companies, one a site, the first `limit` of each query; adds domain and site.

    With `allowed`, only hosts at or below these, which are then never blocked; with `allow_blocked`,
    no host is. `skip` has more words that leave a result out; `keep_jobs` lets lists of jobs pass.
    A site is a host, or with `keep_path`, and on profile hosts always, an address without query and fragment.
    """
    title, snippet, url = F.col("title"), F.col("snippet"), F.col("url")
    rows = found.withColumn("domain", n.domain_key(url))
    host = F.col("domain")
    good = (host != "") & ~is_skipped(title, snippet, url, skip, keep_jobs) & is_local(title, snippet, url, F.col("query"), host)
    if allowed:
        good = good & below(host, allowed)
    elif not allow_blocked:
        good = good & ~below(host, v.BLOCKED_HOSTS)
    path = F.lower(js.sub(js.sub(url, r"[?#].*$", "", "s"), "/$", ""))
    site = F.when(F.lit(keep_path) | below(host, ("linkedin.com",)), path).otherwise(F.concat(F.lit("site://"), host))
    rows = rows.where(good).withColumn("site", site)
    held = F.min(F.struct("pos", "title", "url", "snippet", "domain")).alias("r")
    first = rows.groupBy("query", "site").agg(held).select("query", "site", "r.*")
    # A query's results are a page or two: the first of its sites are few.
    best = first.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", "site", "title", "url", "snippet", "domain"))), 1, limit).alias("r"))
    return best.select("query", F.inline("r"))


def mail_domain(company_words: Column, text: Column) -> Column:
    """The host in a text that fits a company's words best, the shorter of equals; empty if none does."""
    host = lambda raw: n.domain_key(js.sub(raw, "[),.;]+$", ""))
    hosted = F.transform(js.every(text, v.MAIL_URL, 1), lambda r: F.struct(r.alias("raw"), host(r).alias("host")))

    def scored(r: Column, at: Column) -> Column:
        own = js.sub(js.sub(r["host"], r"\.(?:com|ca|net|org|co|us|io)$", "", "i"), "[^a-z0-9]", "", "i")
        fits = lambda own: F.aggregate(
            company_words, F.lit(0),
            lambda total, w: total + F.when(F.contains(own, w) | F.contains(w, own), F.when(F.length(w) >= 6, 10).otherwise(6)).otherwise(0),
        )
        points = js.let(own, fits) + F.when(js.test(r["host"], v.DIRECTORY_HOST), -20).otherwise(0) + F.when(js.test(r["raw"], r"\b(?:careers|jobs|hiring)\b"), -5).otherwise(0)
        return F.struct((-points).alias("rank"), F.length(r["host"]).alias("size"), at.alias("at"), r["host"].alias("host"))

    def best(usable: Column) -> Column:
        once = F.filter(usable, lambda r, i: F.array_position(usable["host"], r["host"]) == i + 1)
        fit = F.filter(F.transform(once, scored), lambda s: s["rank"] < 0)
        return F.coalesce(F.get(F.array_sort(fit), F.lit(0))["host"], F.lit(""))

    usable = F.filter(hosted, lambda r: (r["host"] != "") & ~js.test(r["host"], v.SOCIAL_HOST))
    return F.when(F.size(company_words) > 0, js.let(usable, best)).otherwise("")
