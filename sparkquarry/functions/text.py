"""Plain text, phone and URL normalisers as column expressions; keys of names are in `names`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkquarry.functions import js

BLANKS = r"[ \t\n\r\f\x0B]+"

def _col(value: Column | str) -> Column:
    return F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(""))


def clean_text(value: Column | str) -> Column:
    """Runs of white space as one blank, none at the ends; null becomes empty."""
    return F.btrim(F.regexp_replace(_col(value), BLANKS, " "))


def strip_html(value: Column | str) -> Column:
    """The text of an HTML page: scripts, styles and tags are blanks."""
    text = F.regexp_replace(_col(value), r"(?is)<script[^>]*>.*?</script>", " ")
    text = F.regexp_replace(text, r"(?is)<style[^>]*>.*?</style>", " ")
    return clean_text(F.regexp_replace(text, r"<[^>]+>", " "))


def html_field(value: Column | str, tag: str) -> Column:
    """The text of the first element of that name, empty if there is none."""
    return strip_html(F.regexp_extract(_col(value), rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1))


def phone_key(value: Column | str) -> Column:
    """The last ten digits, empty if there are fewer."""
    digits = F.regexp_replace(_col(value), "[^0-9]", "")
    return F.when(F.length(digits) < 10, "").otherwise(F.right(digits, F.lit(10)))


def host(value: Column | str) -> Column:
    """A URL's host in lower case, without www."""
    return F.regexp_extract(F.lower(_col(value)), r"^[a-z][a-z0-9+.-]*://(?:www\.)?([^/:?#]+)", 1)


def site_key(value: Column | str) -> Column:
    """site://host, or empty for what isn't a URL."""
    found = host(value)
    return F.when(found == "", "").otherwise(F.concat(F.lit("site://"), found))


def canonical_url(value: Column | str) -> Column:
    """Without query, fragment and closing slashes."""
    return F.regexp_replace(F.regexp_replace(_col(value), r"[?#].*$", ""), "/+$", "")


def emails(value: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(_col(value)), F.lit(r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"), F.lit(0)))


def phones(value: Column | str) -> Column:
    return F.regexp_extract_all(_col(value), F.lit(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"), F.lit(0))


def tokens(value: Column | str) -> Column:
    """Distinct lower-case words of two letters or more, split at everything else."""
    words = F.split(F.lower(_col(value)), "[^a-z]+")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= 2))


def jaccard(left: Column, right: Column) -> Column:
    """Shared by all tokens of two sets; 0 if both are empty."""
    both = F.size(F.array_union(left, right))
    return F.when(both == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(left, right)) / both)


def locale_order(value: Column | str, locale: str = "UNICODE") -> Column:
    """A text by which rows sort as a reader of `locale` expects: accents and case only part what is alike
    without them. The collation also holds in windows, and in a sort over all rows, which deals them to ranges by it."""
    return F.collate(F.coalesce(_col(value), F.lit("")), locale)


def listed(value: Column | str) -> Column:
    """The entries of a text that bars part, cleaned, empty ones left out."""
    return F.filter(F.transform(F.split(_col(value), r"\|"), js.clean), lambda x: x != "")
