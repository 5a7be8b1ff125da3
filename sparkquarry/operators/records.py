"""Records of leads: their stage, tags, notes, and the rows that the CRM takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkquarry.functions import contacts as c
from sparkquarry.functions import js
from sparkquarry.functions import names as n
from sparkquarry.functions import values as v
from sparkquarry.operators import relational as r


def tag_list(tags: Column, separator: str = r"\|") -> Column:
    """The tags of a joined text, cleaned, without empty ones; as many as there are."""
    return F.filter(F.transform(js.split(tags, separator), js.clean), lambda t: t != "")


def joined_tags(*parts: Column) -> Column:
    """Lists of tags as one text, each tag once where it came first."""
    return F.array_join(n.distinct_in_order(F.concat(*parts)), " | ")


def lead_stage(has_contact: Column, has_products: Column) -> Column:
    return (
        F.when(~has_contact & ~has_products, v.STAGES[3]).when(~has_contact, v.STAGES[2]).when(~has_products, v.STAGES[1]).otherwise(v.READY)
    )


def lead_tags(has_link: Column, has_contact: Column, has_products: Column, stage: Column) -> Column:
    contact = F.when(has_link, "contact:linkedin-direct").when(has_contact, "contact:public-named").otherwise("contact:missing")
    products = F.when(has_products, "products:confirmed").otherwise("products:missing")
    return F.array_compact(F.array(F.lit("plant-verified"), F.when(stage == v.READY, "outreach-ready"), contact, products))


def notes_section(notes: Column, heading: str) -> Column:
    """What stands below a bold heading, up to the next one after a blank line."""
    return js.trim(js.first(notes, rf"\*\*{heading}\*\*\s*([\s\S]*?)(?:\n\n\*\*|$)", 1))


def with_section(notes: Column, heading: str, body: Column, known_as: tuple[str, ...] = ()) -> Column:
    """The notes with the section's body replaced, or with the section at their end."""
    text = js.trim(notes)
    names = "|".join(js.java(h).replace("/", "/").replace("?", r"\?") for h in (heading, *known_as))
    section = rf"(?i)(?:\n\n)?\*\*(?:{names})\*\*{js.java(r'\s')}*[\s\S]*?(?=\n\n\*\*|\z)"
    new = F.concat(F.lit(f"**{heading}**\n"), F.coalesce(body, F.lit("")))
    at = F.regexp_instr(text, F.lit(section))
    found = F.regexp_extract(text, section, 0)
    before = F.substring(text, F.lit(1), F.when(at > 0, at - 1).otherwise(0))
    after = F.substring(text, at + F.length(found), F.length(text))
    replaced = js.trim(js.sub(F.concat(before, F.lit("\n\n"), new, after), r"^\n+", ""))
    return F.when(at > 0, replaced).when(text == "", new).otherwise(F.concat(text, F.lit("\n\n"), new))


def notes_field(notes: Column, field: str) -> Column:
    """The value of a line `Field: value`."""
    return js.clean(js.first(notes, rf"(?:^|\n){field}:\s*([^\n]+)", 1))


def saved_lead(company: Column, stage: Column, notes: Column, contacts: Column, tags: Column) -> Column:
    """(company, stage, tags) of a saved lead as it should stand; null if it has no company or no plant."""
    name = n.saved_name(company)
    people = js.trim(contacts)
    reachable = (people != "") & ~js.test(people, v.NO_CONTACT)
    section = notes_section(notes, "end products manufactured")
    products = (section != "") & ~js.test(section, v.NO_PRODUCTS)
    now = js.trim(stage)
    then = F.when(now.isin(*v.STAGES), now).otherwise(lead_stage(reachable, products))
    kept = [F.when(F.contains(F.coalesce(tags, F.lit("")), F.lit(t)), t) for t in ("contact:linkedin-direct", "contact:public-named", "contact:leadership-fallback")]
    contact = F.coalesce(*kept, F.when(~reachable, "contact:missing"), F.lit("contact:public-named"))
    own = F.filter(F.transform(js.split(tags, r"\|"), js.trim), lambda t: t != "")
    inferred = F.array_compact(F.array(F.lit("plant-verified"), F.when(then == v.READY, "outreach-ready"), contact, F.when(products, "products:confirmed").otherwise("products:missing")))
    good = (name != "") & ~js.test(notes, v.NO_PLANT)
    return F.when(good, F.struct(name.alias("company"), then.alias("stage"), joined_tags(own, inferred).alias("tags")))


def with_contact_tag(tags: Column, has_contact: Column, has_link: Column) -> Column:
    """Tags with the mark of what contacts there are now in place of the old ones."""
    known = F.array(*map(F.lit, ("contact:missing", "contact:public-named", "contact:linkedin-direct", "needs-contact-backfill")))
    mark = F.when(~has_contact, "contact:missing").when(has_link, "contact:linkedin-direct").otherwise("contact:public-named")
    return n.distinct_in_order(F.concat(F.filter(tags, lambda t: ~F.array_contains(known, t)), F.array(mark)))


def plain_date(value: Column) -> Column:
    """A date as yyyy-mm-dd, as it is; empty for all else."""
    text = js.clean(value)
    return F.when(js.test(text, r"^\d{4}-\d{2}-\d{2}$"), text).otherwise("")


def existing_records(companies: DataFrame, contacts: DataFrame) -> DataFrame:
    """CRM companies (id, company, stage, industry, end_product, signals, last_contact, tags) as records
    of the duplicate check, with a line of name, title and link for each of `contacts` (company_id, pos, name, title, linkedin)."""
    line = F.array_join(F.filter(F.array(js.clean("name"), js.clean("title"), js.clean("linkedin")), lambda x: x != ""), ", ")
    lines = contacts.select("company_id", "pos", line.alias("line")).where("line <> ''")
    lines = lines.groupBy("company_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("contacts"))
    product = js.clean("end_product")
    notes = F.filter(F.array(js.clean("signals"), F.when(product != "", F.concat(F.lit("End products: "), product))), lambda x: x != "")
    tags = tag_list(F.col("tags"))
    out = companies.where(js.clean("company") != "").join(lines, F.col("id") == F.col("company_id"), "left")
    return out.select(
        "id", js.clean("company").alias("company"), n.first_of(js.clean("stage"), F.lit("Prospect")).alias("stage"), js.clean("industry").alias("industry"),
        F.array_join(notes, "\n").alias("notes"), F.coalesce("contacts", F.lit("")).alias("contacts"), F.array_join(tags, " | ").alias("tags"),
        plain_date(F.col("last_contact")).alias("last_activity"), F.array_contains(tags, "__finder_skip").alias("finder_skip"),
    )


def crm_payload(company: Column, industry: Column, product: Column, notes: Column, last_activity: Column, tags: Column, marks: tuple[str, ...], today: str) -> Column:
    """A lead as the CRM takes it: always a prospect, with the sync's marks among its tags."""
    what = js.clean(product)
    confirmed = (what != "") & ~js.test(what, "not confidently confirmed from public pages yet") & ~js.test(what, r"^inferred from plant/query context\s*-\s*")
    return F.struct(
        js.clean(company).alias("company"), F.lit("Prospect").alias("stage"), js.clean(industry).alias("industry"), F.when(confirmed, what).otherwise("").alias("end_product"),
        js.clean(notes).alias("signals"), n.first_of(plain_date(last_activity), F.lit(today)).alias("last_contact"),
        n.distinct_in_order(F.concat(tag_list(tags), F.array(*map(F.lit, marks)))).alias("tags"),
    )


def crm_contacts(contacts: DataFrame) -> DataFrame:
    """The rows of `contacts` (company_id, pos, name, title, linkedin, source_url) worth saving, each (name,
    title, link) of a company once in any case of letters, the one that came first."""
    link = n.first_of(F.coalesce("linkedin", F.lit("")), F.coalesce("source_url", F.lit("")))
    rows = contacts.select("company_id", "pos", js.clean("name").alias("name"), js.clean("title").alias("title"), js.clean(link).alias("linkedin"))
    rows = rows.where(c.is_worth_saving(F.col("name"), F.col("title"), F.col("linkedin")))
    lower = rows.select("*", *[F.lower(x).alias(f"_{x}") for x in ("name", "title", "linkedin")])
    first = r.first_value_per_key(lower, ["company_id", "_name", "_title", "_linkedin"], F.col("pos"), ["pos", "name", "title", "linkedin"])
    return first.select("company_id", "pos", "name", "title", "linkedin")


def facility_line(name: Column, address: Column, phone: Column, email: Column, url: Column) -> Column:
    said = lambda label, x: F.when(js.clean(x) != "", F.concat(F.lit(label), js.clean(x))).otherwise("")
    parts = F.array(js.clean(name), js.clean(address), said("phone ", phone), said("email ", email), js.clean(url))
    return F.array_join(F.filter(parts, lambda x: x != ""), " | ")


def lead_notes(company: Column, facilities: Column, products: Column, equipment: Column, signals: Column, proof: Column) -> Column:
    """A lead's notes: five sections below fixed headings; lists that are empty say so."""
    unsure = "Not confidently confirmed from public pages yet."
    told = lambda lines, by, other: F.when(F.size(lines) > 0, F.array_join(lines, by)).otherwise(other)
    sections = (
        ("manufacturing facilities (southern ontario)", told(facilities, "\n", "No confirmed southern Ontario manufacturing plant found.")),
        ("end products manufactured", n.first_of(F.coalesce(products, F.lit("")), F.lit(unsure))),
        ("major production machinery", told(equipment, ", ", unsure)),
        ("recent hiring / expansion signals", told(signals, "\n\n", "No relevant hiring or expansion signal found after targeted search.")),
        ("public proof / source notes", told(proof, "\n", "No additional cited proof captured yet.")),
    )
    return F.concat(company, F.lit(" (verified plant lead)"), *[F.concat(F.lit(f"\n\n**{heading}**\n"), body) for heading, body in sections])


def contact_block(name: Column, title: Column, link: Column, source: Column, notes: Column) -> Column:
    """A contact in a lead's text, one labelled line for each thing known."""
    said = lambda label, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(f"{label} - "), x))
    lines = F.array(F.concat(F.lit("Name - "), name), F.concat(F.lit("Title - "), title), said("LinkedIn", link), said("Source", source), said("Notes", notes))
    return F.array_join(F.array_compact(lines), "\n")


def number(value: Column, other: float = 0.0) -> Column:
    """A text as a number: an empty one is 0, what isn't a number is `other`, and so is null."""
    text = js.trim(value)
    found = F.when(text == "", 0.0).otherwise(F.when(js.test(text, r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?$"), text.cast("double")))
    return F.when(value.isNull(), other).otherwise(F.coalesce(found, F.lit(other)))


#: The columns of the flat file.
FLAT_COLUMNS = (
    "record_type", "company", "name", "title_or_type", "address", "city", "province", "postal_code", "phone", "fax", "email", "linkedin_url", "source_url", "notes",
)


def flattened(results: DataFrame) -> DataFrame:
    """A row of FLAT_COLUMNS for every facility and every contact of `results` (company, facilities, contacts:
    arrays of structs with some of these columns, `facility_type`, `title` or `role_match`). What is missing is empty."""

    def rows(kind: str, column: str, renamed: dict[str, tuple[str, ...]]) -> DataFrame:
        each = results.select("company", F.explode(column).alias("r"))
        known = {f.name for f in each.schema["r"].dataType.fields}
        text = lambda *names: n.first_of(*[F.coalesce(F.col(f"r.{x}").cast("string"), F.lit("")) for x in names if x in known], F.lit(""))
        fixed = {"record_type": F.lit(kind), "company": F.coalesce("company", F.lit(""))}
        return each.select(*[fixed.get(c, text(*renamed.get(c, (c,)))).alias(c) for c in FLAT_COLUMNS])

    contact = {c: () for c in ("address", "city", "province", "postal_code", "fax")}
    facility = {"title_or_type": ("facility_type",), "linkedin_url": ()}
    return rows("facility", "facilities", facility).unionByName(rows("contact", "contacts", contact | {"title_or_type": ("title", "role_match")}))


def intelligence(verdict: Column, company: Column, products: Column, equipment: Column, website: Column, source_url: Column, city: Column) -> Column:
    """What is known of a lead: a verifier's `verdict` (see gates.verify_plant) put together with what enrichment
    found (lists, which come first). Contacts are found later, so there are none and the stage says so."""
    none = F.array().cast("array<string>")
    merged = lambda found, field: n.distinct_in_order(F.transform(F.concat(F.coalesce(found, none), F.coalesce(verdict[field], none)), js.clean))
    made = F.array_join(merged(products, "end_products"), ", ")
    facility, stage = verdict["facility"], lead_stage(F.lit(False), made != "")
    lines = F.when(facility.isNotNull(), F.array(facility_line(facility["name"], facility["address"], facility["phone"], F.lit(""), facility["source_url"]))).otherwise(none)
    tools = merged(equipment, "likely_equipment")
    proof = F.when(F.coalesce(verdict["evidence"], F.lit("")) != "", F.array(F.concat_ws(" | ", js.clean(verdict["evidence"]), F.nullif(js.clean(source_url), F.lit(""))))).otherwise(none)
    return F.struct(
        js.clean(company).alias("company"), js.clean(website).alias("website"), js.clean(city).alias("city"), n.first_of(made, F.lit("Not confidently confirmed from public pages yet.")).alias("products"),
        tools.alias("equipment"), stage.alias("stage"), F.array_join(lead_tags(F.lit(False), F.lit(False), made != "", stage), " | ").alias("tags"),
        lead_notes(js.clean(company), lines, made, tools, none, proof).alias("notes"),
    )


def packet(text: Column, first: Column, urls: Column, most: int = 24) -> Column:
    """An evidence packet: snippets that come first, then a text's telling sentences, each once, `most` at most; and its addresses, each once."""
    told = n.distinct_in_order(F.concat(F.transform(first, js.clean), evidence(text, 10)))
    return F.struct(F.slice(told, 1, most).alias("snippets"), n.distinct_in_order(F.transform(urls, js.clean)).alias("urls"))


def evidence(text: Column, most: int = 12) -> Column:
    """The first sentences of thirty letters or more that tell of a plant, each once."""
    sentences = F.transform(js.split(js.sub(text, r"\s+", " "), r"(?<=[.!?])\s+"), js.clean)
    return F.slice(n.distinct_in_order(F.filter(sentences, lambda s: (F.length(s) >= 30) & js.test(s, v.EVIDENCE))), 1, most)


def skip_keys(domain: Column, name: Column, city: Column) -> Column:
    """The keys by which a rejected candidate is remembered: its own domain, and its name in its city."""
    host, who, where = n.domain_key(domain), n.dedupe_name(name), n.dedupe_name(city)
    words = F.filter(F.split(who, " "), lambda w: (F.length(w) >= 5) & ~w.isin(*v.SKIP_TOKENS))
    by_host = (host != "") & ~js.test(host, v.SKIP_HOSTS)
    by_name = (F.length(who) >= 5) & ~js.test(who, v.SKIP_NAMES) & (F.size(words) > 0) & (where != "")
    return F.array_compact(F.array(F.when(by_host, F.concat(F.lit("domain:"), host)), F.when(by_name, F.concat(F.lit("name-city:"), who, F.lit("::"), where))))
