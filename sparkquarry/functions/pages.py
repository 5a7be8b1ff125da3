"""What a company's web page tells: its names, contacts, addresses and links, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkquarry.functions import js
from sparkquarry.functions import lines as ln
from sparkquarry.functions import names as n
from sparkquarry.functions import values as v


def decode(value: Column) -> Column:
    for pattern, to in v.ENTITIES:
        value = js.sub(value, pattern, to, "i")
    return value


def text_lines(html: Column) -> Column:
    """A page's text: scripts and styles are blanks, tags are line ends."""
    text = js.sub(js.sub(html, r"<script[\s\S]*?</script>", " ", "i"), r"<style[\s\S]*?</style>", " ", "i")
    text = js.sub(text, r"<[^>]+>", "\n")
    for entity, to in (("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'")):
        text = js.sub(text, entity, to, "i")
    return js.trim(js.sub(js.sub(js.sub(text, r"\n{2,}", "\n"), r"\s+\.$", ""), r"\s+\.$", ""))


def own_lines(text: Column) -> Column:
    """Trimmed lines that aren't empty."""
    return F.filter(F.transform(js.split(text, r"\n+"), js.trim), lambda x: x != "")


def snippets(text: Column) -> Column:
    return F.filter(own_lines(text), lambda x: F.length(x).between(20, 320))


def company_name(value: Column) -> Column:
    """A page's heading as a company's name: without the words of home pages and what follows a bar or a dash."""
    name = js.sub(js.sub(decode(value), r"\s+", " "), r"\b(home|welcome|contact us|about us)\b", "", "i")
    name = js.sub(name, r"\s+[|:]\s+.*", "")
    return js.trim(js.sub(name, r"\s+[–-]\s+(local .*|making .* possible|over \d+.*|company .*|our story.*|who we are.*)$", "", "i"))


def sentence(value: Column) -> Column:
    return js.trim(js.sub(js.sub(js.sub(value, r"\s+", " "), r"\b(learn more|read more|contact us)\b.*$", "", "i"), r"\s+\|.*$", ""))


def address(value: Column) -> Column:
    text = js.sub(js.sub(value, r"\s+", " "), r"\s+,", ",")
    for start in v.ADDRESS_START:
        text = js.sub(text, start, "", "i")
    return js.trim(text)


def _element(html: Column, tag: str) -> Column:
    return company_name(text_lines(js.first(html, rf"<{tag}[^>]*>([\s\S]*?)</{tag}>", 1)))


def title(html: Column) -> Column:
    return _element(html, "title")


def heading(html: Column) -> Column:
    return _element(html, "h1")


def description(html: Column) -> Column:
    return decode(js.first(html, r"""<meta[^>]+name=["']description["'][^>]+content=["']([^"']+)["']""", 1))


def site_name(html: Column) -> Column:
    graph = decode(js.first(html, r"""<meta[^>]+property=["']og:site_name["'][^>]+content=["']([^"']+)["']""", 1))
    other = js.sub(decode(js.first(html, r"""<meta[^>]+name=["']twitter:site["'][^>]+content=["']([^"']+)["']""", 1)), "^@", "")
    return n.first_of(graph, other)


def organisation(html: Column) -> Column:
    """The name of the first organisation in the page's linked data: the nodes at the top of every block, then those in their graphs."""
    json = F.transform(js.every(html, r"""<script[^>]+type=["']application/ld\+json["'][^>]*>([\s\S]*?)</script>""", 1), lambda b: js.trim(decode(b)))
    entries = lambda x: F.from_json(x, "array<string>")
    inner = lambda node: F.coalesce(entries(F.get_json_object(node, "$['@graph']")), F.array().cast("array<string>"))

    def name_in(block: Column) -> Column:
        top = F.when(block.startswith("["), F.coalesce(entries(block), F.array().cast("array<string>"))).otherwise(F.array(block))
        nodes = F.concat(top, F.flatten(F.transform(top, inner)))
        fits = lambda x: js.test(F.get_json_object(x, "$['@type']"), v.ORGANISATION) & (F.coalesce(F.get_json_object(x, "$.name"), F.lit("")) != "")
        return F.get(F.transform(F.filter(nodes, fits), lambda x: decode(F.get_json_object(x, "$.name"))), F.lit(0))

    return F.coalesce(F.get(F.array_compact(F.transform(json, name_in)), F.lit(0)), F.lit(""))


def emails(text: Column) -> Column:
    return n.distinct_in_order(js.every(text, v.EMAIL))


def faxes(text: Column) -> Column:
    """Numbers in lines that speak of a fax."""
    of_fax = F.filter(own_lines(text), lambda x: js.test(x, r"\b(?:fax|facsimile)\b") | js.test(x, r"\bF\s*:"))
    return n.distinct_in_order(F.flatten(F.transform(of_fax, lambda x: js.every(x, v.PHONE, 0, ""))))


def phones(text: Column) -> Column:
    """Numbers that aren't a fax's, by their digits."""
    digits = lambda x: js.sub(x, "[^0-9]", "")
    known = F.transform(faxes(text), digits)
    return F.filter(n.distinct_in_order(js.every(text, v.PHONE, 0, "")), lambda x: ~F.array_contains(known, digits(x)))


def is_address(value: Column) -> Column:
    """Does it look like an address in the target area?"""
    def fits(text: Column) -> Column:
        placed = js.test(text, r"\b(?:Ontario|ON)\b") | js.test(F.lower(text), v.ADDRESS_CITY, "")
        exact = js.test(text, v.POSTAL) | js.test(text, v.ADDRESS_TYPE)
        return F.length(text).between(14, 220) & ~js.test(F.lower(text), v.ADDRESS_OFFICE, "") & js.test(text, v.ADDRESS_STREET) & placed & exact

    return js.let(address(value), fits)


def addresses(text: Column) -> Column:
    """Addresses in one to three lines that follow each other, by their first line."""
    found = F.transform(ln.spans(own_lines(text), 3, ", "), lambda s: address(s["text"]))
    return n.distinct_in_order(F.filter(found, is_address))


def best_address(found: Column, city: Column) -> Column:
    """The first address in the expected city, else the first."""
    there = F.filter(found, lambda a: (F.coalesce(city, F.lit("")) != "") & F.contains(F.lower(a), F.lower(city)))
    return F.coalesce(F.get(there, F.lit(0)), F.get(found, F.lit(0)), F.lit(""))


def origin(url: Column) -> Column:
    return F.lower(js.first(url, r"^[a-z][a-z0-9+.-]*://[^/?#]*"))


def absolute(href: Column, url: Column) -> Column:
    """A link's full address, seen from the page at `url`."""
    root = origin(url)
    folder = F.concat(root, n.first_of(js.first(js.sub(js.sub(url, r"[?#].*$", ""), r"^[a-z][a-z0-9+.-]*://[^/]*", "", "i"), r"^/(?:.*/)?"), F.lit("/")))
    return (
        F.when(js.test(href, r"^[a-z][a-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(js.first(url, r"^[a-z][a-z0-9+.-]*:"), href))
        .when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(folder, href))
    )


def telling_links(html: Column, url: Column) -> Column:
    """Links inside the site that may lead to people, products or places, the most telling first."""
    found = F.transform(js.every(html, r"""href\s*=\s*["']([^"'#]+)["']""", 1), lambda h: absolute(h, url))
    path = lambda u: F.lower(js.sub(js.sub(u, r"^[a-z][a-z0-9+.-]*://[^/?#]*", "", "i"), r"[?#].*$", ""))
    rank = lambda u: F.coalesce(*[F.when(F.contains(path(u), F.lit(h)), i) for i, h in enumerate(v.LINK_HINTS)])
    own = F.filter(found, lambda u: (origin(u) == origin(url)) & rank(u).isNotNull())
    ranked = F.array_sort(F.transform(own, lambda u, i: F.struct(rank(u).alias("rank"), i.alias("at"), u.alias("url"))))
    return n.distinct_in_order(F.transform(ranked, lambda x: x["url"]))


def profile_links(html: Column) -> Column:
    """Links to LinkedIn, cut where a quotation mark or closing punctuation ends them."""
    found = F.filter(js.every(html, r"""https?://[^\s"'<>]+"""), lambda u: F.contains(u, F.lit("linkedin.com/")))
    return n.distinct_in_order(F.transform(found, lambda u: js.sub(F.get(F.split(u, "&quot;"), F.lit(0)), "[),.;]+$", "")))


def city(text: Column) -> Column:
    """The first of the known cities that a text names."""
    return js.clean(js.first(text, v.CITIES))


def city_of_address(value: Column) -> Column:
    """The part before `Ontario` of an address parted by commas."""
    parts = F.filter(F.transform(F.split(js.clean(value), ","), js.trim), lambda x: x != "")
    at = F.array_position(F.transform(parts, F.lower), F.lit("ontario"))
    return F.when(at > 1, F.get(parts, (at - 2).cast("int"))).otherwise("")


def is_label(name: Column) -> Column:
    """Is it a page's name and no company's?"""
    return F.lower(company_name(name)).isin(*v.PAGE_LABELS)


def host_tokens(url: Column) -> Column:
    """The words in the first part of a site's host."""
    first = F.get(F.split(n.domain_key(url), r"\."), F.lit(0))
    parts = js.sub(js.sub(first, r"([a-z])(\d)", "$1 $2", "i"), r"(\d)([a-z])", "$1 $2", "i")
    return F.transform(F.filter(js.split(parts, "[^a-zA-Z0-9]+"), lambda x: F.length(x) >= 2), F.lower)


def name_score(name: Column, tokens: Column, times: Column) -> Column:
    """How well a heading, found so many times on a site, fits as its company's name."""
    low = F.lower(name)
    own = F.exists(tokens, lambda t: F.contains(low, t))
    plus = lambda test, k: F.when(test, k).otherwise(0)
    score = times * 3 + plus(own, 6) + plus(F.size(js.split(name, r"\s+")) <= 4, 2)
    return score + plus(js.test(low, r"\b(404|not found|official site)\b", ""), -8) + plus(js.test(low, r"\b(company|solutions|services)\b", "") & ~own, -3)


def truncated(value: Column, most: int) -> Column:
    text = js.clean(value)
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 3)), F.lit("..."))).otherwise(text)


def slug(value: Column) -> Column:
    return js.sub(js.sub(F.lower(js.trim(value)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def title_case(value: Column) -> Column:
    """A capital after every edge of a word, an apostrophe's too."""
    words = F.regexp_extract_all(F.lower(js.clean(value)), F.lit(r"[a-z0-9_]+|[^a-z0-9_]+"), F.lit(0))
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 100000))), "")
