"""Rules of outreach: who is searched for and how, what is written to whom, and what a run notes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkquarry.functions import js
from sparkquarry.functions import names as n

#: Searches for a company's hiring and growth, in order.
SIGNAL_SEARCHES = (
    '"{company}" hiring maintenance {city}', '"{company}" hiring production {city}', '"{company}" hiring operations {city}', '"{company}" millwright {city}',
    '"{company}" brewer job {city}', '"{company}" roaster job {city}', '"{company}" plant manager {city} hiring', '"{company}" expansion {city}',
    '"{company}" "planned expansion" {city}', '"{company}" "new facility" {city}', '"{company}" "new plant" {city}', '"{company}" "production line" {city}',
    '"{company}" "capacity" {city}', '"{company}" "environmental compliance approval"', '"{company}" ECA Ontario expansion',
)
SITE_SEARCHES = ("site:{host} careers maintenance production operations", 'site:{host} expansion "new facility" "new plant"')
#: Searches for a company's people.
PEOPLE_SEARCHES = (
    '"{alias}" LinkedIn', '"{alias}" employees', '"{alias}" employee directory', '"{alias}" management team', 'site:linkedin.com/in "{alias}"',
    'site:ca.linkedin.com/in "{alias}"', 'site:wiza.co "{alias}"', 'site:rocketreach.co "{alias}"', 'site:zoominfo.com "{alias}"',
    'site:signalhire.com "{alias}"', 'site:apollo.io "{alias}"', 'site:theorg.com "{alias}"',
)


def present(value: Column) -> Column:
    return F.btrim(F.coalesce(value, F.lit(""))) != ""


def _filled(form: str, **values: Column) -> Column:
    made = F.lit(form)
    for name, value in values.items():
        made = F.replace(made, F.lit(f"{{{name}}}"), F.coalesce(value, F.lit("")))
    return made


def signal_searches(company: Column, city: Column, host: Column) -> Column:
    """Searches for a company's hiring and growth, each once; without a city in Ontario, without a host not on its site."""
    place = n.first_of(city, F.lit("Ontario"))
    general = [_filled(form, company=company, city=place) for form in SIGNAL_SEARCHES]
    own = [F.when(F.coalesce(host, F.lit("")) != "", _filled(form, host=host)) for form in SITE_SEARCHES]
    return n.distinct_in_order(F.array(*general, *own))


def people_searches(aliases: Column) -> Column:
    """Searches for people under each of a company's names, each once."""
    return n.distinct_in_order(F.flatten(F.transform(aliases, lambda a: F.array(*[_filled(form, alias=a) for form in PEOPLE_SEARCHES]))))


def sweep_score(strong: Column, weak: Column, contacts: Column, least: int, tagged: Column, verified_tag: Column, verified_text: Column, enriched: Column) -> Column:
    """How much a record gains by another search for contacts (fixed weights); `tagged`: it isn't marked as lacking any."""
    plus = lambda test, k: F.when(test, k).otherwise(0)
    missing = 10 + (F.lit(least) - strong) * 20 + plus(contacts == 0, 40) + plus(weak > 0, 15) + plus(~tagged, 35)
    missing += plus(verified_tag, 20) + plus(verified_text, 15) - plus(enriched, 5)
    return F.when(strong >= least, plus(weak > 0, 5)).otherwise(missing)


def first_label(text: Column, presets: list[tuple[str, str]], other: str) -> Column:
    """The label of the first preset (words, label) that the text contains."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(*[F.when(F.contains(low, F.lit(words)), label) for words, label in presets], F.lit(other))


def _addresses(first: Column, last: Column, domain: Column) -> Column:
    both = (first != "") & (last != "")
    local = F.array(
        F.when(both, F.concat(first, F.lit("."), last)), F.when(both, F.concat(first, last)), F.when(both, F.concat(F.left(first, F.lit(1)), last)), F.nullif(first, F.lit("")), F.nullif(last, F.lit(""))
    )
    return F.array_distinct(F.transform(F.array_compact(local), lambda x: F.concat(x, F.lit("@"), domain)))


def email_guesses(first: Column, last: Column, domain: Column) -> Column:
    """Likely addresses of a person, likeliest first, each once; none without name or domain."""
    a, b = (F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "") for c in (first, last))
    return F.when((a != "") & (b != "") & present(domain), _addresses(a, b, domain)).otherwise(F.array().cast("array<string>"))


def personal_addresses(name: Column, domain: Column) -> Column:
    """As email_guesses, of a full name: titles before it and names in its middle don't count, one name alone is enough."""
    host = js.sub(F.lower(F.btrim(F.coalesce(domain, F.lit("")))), r"^www\.", "")
    words = F.split(js.clean(js.sub(F.lower(F.coalesce(name, F.lit(""))), r"[^a-z\s'-]", " ")), " ")
    parts = F.filter(words, lambda p: (p != "") & ~js.test(p, r"^(mr|mrs|ms|dr|prof|sir|madam)$"))
    own = F.transform(parts, lambda p: js.sub(p, "[^a-z0-9]", ""))

    def ends(own: Column) -> Column:
        last = F.when(F.size(own) > 1, F.element_at(F.when(F.size(own) > 0, own), -1)).otherwise("")
        return F.struct(F.coalesce(F.get(own, F.lit(0)), F.lit("")).alias("first"), last.alias("last"))

    def made(x: Column) -> Column:
        return F.when(x["host"] != "", _addresses(x["n"]["first"], x["n"]["last"], x["host"])).otherwise(F.array().cast("array<string>"))

    return js.let(F.struct(js.let(own, ends).alias("n"), host.alias("host")), made)


def run_note(at: Column, template: Column, name: Column, title: Column, row: Column, sent: Column, failed: Column, tried: Column) -> Column:
    """What a run notes of a contact: when, by which template, to whom, and what became of it."""
    said = lambda label, x: F.concat(F.lit(label), x)
    joined = lambda x: F.array_join(x, ", ")
    who = F.when(present(name), F.concat(F.lit("Contact: "), name, F.when(present(title), F.concat(F.lit(", "), title)).otherwise("")))
    went, none = F.size(sent) > 0, F.size(tried) == 0
    lines = F.array(
        at, said("Template: ", template), who, said("Contact row: manufacturer_contacts #", row.cast("string")),
        F.when(went, "Result: sent").when(none, "Result: nothing sent (daily limit or empty candidate list)").otherwise("Result: all failed"),
        F.when(went, said("Emails that seemed to go through: ", joined(sent))).when(~none, said("Emails tried: ", joined(tried))),
        F.when(went & (F.size(failed) > 0), said("Failed: ", joined(failed))),
    )
    return F.array_join(F.array_compact(lines), "\n")
