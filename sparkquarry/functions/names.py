"""Keys of companies, persons, addresses and hosts, as column expressions.

Null is an empty text everywhere; a key that nothing is left of is empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkquarry.functions import js
from sparkquarry.functions import values as v


def _whole_words(words: str) -> str:
    return rf"\b(?:{words})\b"


def _squeezed(value: Column | str) -> Column:
    """ASCII letters and digits of a lower-cased text, one blank for all between."""
    return F.btrim(js.sub(value, "[^a-z0-9]+", " "))


def _company_key(value: Column | str, left_out: str) -> Column:
    low = js.sub(F.lower(value), "&", " and ")
    return _squeezed(js.sub(low, _whole_words(left_out), " "))


def dedupe_name(value: Column | str) -> Column:
    """A name's key in the duplicate check: & as and, without legal suffixes."""
    return _company_key(_text(value), v.LEGAL)


def census_name(value: Column | str) -> Column:
    """A company's key in the census: without legal suffixes, places and words that say little."""
    return _company_key(js.clean(decode(value, v.ENTITIES_RESEARCH)), v.CENSUS_WORDS)


def search_name(value: Column | str) -> Column:
    """A company's key in the research pass."""
    return _company_key(js.clean(decode(value, v.ENTITIES_RESEARCH)), v.SEARCH_WORDS)


def company_key(value: Column | str) -> Column:
    """A company's key in enrichment: all its words."""
    return _squeezed(F.lower(decode(value, v.ENTITIES_RESEARCH, numbers=True)))


def company_tokens(value: Column | str) -> Column:
    """The words of a company's key that tell it from others."""
    return F.filter(F.split(company_key(value), " "), lambda w: (F.length(w) > 1) & ~w.isin(*v.NOT_TOKENS))


def census_tokens(value: Column | str) -> Column:
    """Distinct words of three letters or more of a census key."""
    return F.array_distinct(F.filter(F.split(census_name(value), " "), lambda w: F.length(w) >= 3))


def person_key(value: Column | str) -> Column:
    """A person's key: nicknames as full names, without initials."""
    key = F.lower(js.clean(value))
    for short, full in v.NICKNAMES:
        key = js.sub(key, _whole_words(short), full)
    return _squeezed(js.sub(key, r"\b[a-z]\.?\b", " "))


def address_key(value: Column | str) -> Column:
    """An address's key: streets and directions abbreviated, without postal code, province and country."""
    key = F.lower(_text(value))
    for word, short in v.STREET_WORDS:  # each is tried only where its letters stand
        key = js.let(key, lambda k: F.when(F.contains(k, F.lit(word)), js.sub(k, _whole_words(word), f" {short} ")).otherwise(k))  # noqa: B023
    key = js.sub(key, v.POSTAL, " ", "i")
    return _squeezed(js.sub(key, _whole_words("ontario|canada|on"), " "))


def phone_key(value: Column | str) -> Column:
    """The last ten digits, empty if there are fewer."""
    return js.let(js.sub(value, r"[^0-9]+", ""), lambda digits: F.when(F.length(digits) < 10, "").otherwise(F.right(digits, F.lit(10))))


def phone_dashed(value: Column | str) -> Column:
    """NNN-NNN-NNNN of ten digits, or eleven that start with 1; else empty."""
    ten = lambda digits: F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).when(F.length(digits) == 10, digits)
    dashed = lambda x: F.concat(F.substring(x, 1, 3), F.lit("-"), F.substring(x, 4, 3), F.lit("-"), F.substring(x, 7, 4))
    return F.coalesce(js.let(js.let(js.sub(value, r"[^0-9]", ""), ten), dashed), F.lit(""))


def domain_key(value: Column | str) -> Column:
    """The host of the first entry with a dot, without www and in lower case; none for linkedin.com."""
    entries = F.filter(js.split(js.trim(value), r"[;,|\s]+"), lambda x: F.contains(x, F.lit(".")))
    entry = F.coalesce(F.get(entries, F.lit(0)), F.lit(""))
    rest = js.sub(js.sub(entry, r"^[a-z][a-z0-9+.-]*://", "", "i"), r"^[^/?#]*@", "")
    host = F.lower(js.sub(js.sub(js.sub(rest, r"[/?#].*$", "", "s"), r":\d*$", ""), r"^www\.", "", "i"))
    return js.let(host, lambda h: F.when(h == "linkedin.com", "").otherwise(h))


def decode(value: Column | str, entities, numbers: bool = False) -> Column:
    """The text with its named entities replaced in the order given; with `numbers`, decimal ones too."""
    text = reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), entities, _text(value))
    if not numbers:
        return text

    def char(piece: Column) -> Column:
        digits = F.regexp_extract(piece, r"^(\d+);", 1)
        code = F.try_to_number(F.concat(F.lit("0"), F.right(digits, F.lit(9))), F.lit("9999999999")).cast("int")
        return F.concat(_char(code), F.substring(piece, F.length(digits) + 2, F.length(piece)))

    whole = lambda pieces: F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(F.slice(pieces, 2, F.size(pieces)), char), ""))
    return js.let(text, lambda t: F.when(F.contains(t, F.lit("&#")), js.let(js.split(t, r"&#(?=\d+;)"), whole)).otherwise(t))


def _char(code: Column) -> Column:
    """The UTF-16 unit of a number, as a text."""
    hexed = F.lpad(F.hex(F.pmod(code, F.lit(65536))), 4, F.lit("0"))
    return F.decode(F.unhex(hexed), "UTF-16BE")


def saved_name(value: Column | str) -> Column:
    """A saved lead's company without the page's name before it or a comma behind it."""
    return js.trim(js.sub(js.sub(value, r"^(about|location|homepage)\s*-\s*", "", "i"), r"\s*,\s*$", ""))


def shown_name(value: Column | str) -> Column:
    """A company's name as searched for: without the page's name before it or an address behind it."""
    name = js.sub(saved_name(value), r"^(contact|contacts|product|products|about|location|locations|home|homepage)\s*-\s*", "", "i")
    name = js.sub(js.sub(name, r"\s+-\s+\d{1,6}\s+.*$", "", "i"), "^[-\"' ]+|[-\"' ]+$", "")
    return decode(js.clean(name), v.ENTITIES_RESEARCH, numbers=True)


def aliases(value: Column | str) -> Column:
    """Names to search a company by, each once: as it is, without its legal suffix, and and & exchanged, its first two brand words."""
    def found(name: Column) -> Column:
        short = js.trim(js.sub(name, rf"\b(?:{v.SUFFIX_WORDS})\.?$", "", "i"))
        words = F.filter(js.split(js.sub(name, "[()]", " "), r"\s+"), lambda w: (w != "") & ~js.test(w, rf"^({v.SUFFIX_WORDS}|and|the)$"))
        return F.array(
            name, js.let(short, lambda x: F.when((x != "") & (x != name), x)), F.when(js.test(name, r"\band\b"), js.sub(name, r"\band\b", "&", "i")),
            F.when(F.contains(name, F.lit("&")), F.replace(name, F.lit("&"), F.lit("and"))), js.let(words, lambda ws: F.when(F.size(ws) >= 2, F.array_join(F.slice(ws, 1, 2), " "))),
        )

    every = js.let(js.clean(js.sub(shown_name(value), "[®™©]", "")), found)
    return F.array_distinct(F.filter(F.transform(every, lambda x: F.when(x.isNotNull(), js.clean(x))), lambda x: F.length(x) >= 3))


def alias_score(alias: Column) -> Column:
    """How unlikely a name is to find the company; the smallest comes first."""
    plus = lambda test, n: F.when(test, n).otherwise(0)
    counted = js.let(F.size(js.split(js.clean(alias), " ")), lambda words: plus((words >= 2) & (words <= 5), -8))
    return (
        plus(~js.test(alias, r"\s"), 12) + plus(js.test(alias, v.JUNK_ALIAS), 40) + plus(F.length(alias) > 45, 12)
        + counted + plus(F.contains(alias, F.lit("&")), -2)
    )


def best_aliases(value: Column | str, most: int = 5) -> Column:
    """The `most` likeliest names, ties in their order."""
    ranked = F.array_sort(F.transform(aliases(value), lambda a, i: F.struct(alias_score(a).alias("score"), i.alias("at"), a.alias("alias"))))
    return F.transform(F.slice(ranked, 1, most), lambda r: r["alias"])


def first_of(*values: Column) -> Column:
    """The first that isn't empty, else empty."""
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in values], F.lit(""))


def distinct_in_order(values: Column, ignore_case: bool = False) -> Column:
    """Each entry that isn't empty once, where it came first; with `ignore_case` cleaned, and alike if only case differs."""
    kept = F.filter(values, lambda x: F.coalesce(x, F.lit("")) != "")
    if not ignore_case:
        return F.array_distinct(kept)
    once = lambda rows, keys: F.filter(rows, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1)
    cleaned = F.filter(F.transform(kept, js.clean), lambda x: x != "")
    return js.let(cleaned, lambda rows: js.let(F.transform(rows, F.lower), lambda keys: once(rows, keys)))


def _text(value: Column | str) -> Column:
    return F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(""))
