"""Decisions on companies: the verifier's five gates, the strict guard, industries, scores, outreach."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkquarry.functions import js
from sparkquarry.functions import values as v
from sparkquarry.functions.contacts import _points
from sparkquarry.functions.names import distinct_in_order, first_of


def _named(text: Column, table, other: str) -> Column:
    """The labels of all patterns that a lower-cased text matches; `other` if none does."""
    found = F.array_compact(F.array(*[F.when(js.test(text, pattern, ""), label) for pattern, label in table]))
    return F.when(F.size(found) == 0, F.array(F.lit(other))).otherwise(found)


def candidate_text(hint: Column, query: Column, title: Column, url: Column, snippets: Column) -> Column:
    parts = F.concat(F.array(hint, query, title, url), F.coalesce(snippets, F.array().cast("array<string>")))
    return F.array_join(F.filter(parts, lambda x: F.coalesce(x, F.lit("")) != ""), "\n")


def default_reason(real: Column, operator: Column, in_range: Column, makes: Column, industrial: Column, proven: Column) -> Column:
    """Why a candidate isn't qualified: the first gate, in this order, that it fails; empty if it fails none."""
    gates = (real, operator, in_range, makes, industrial, proven)
    return F.coalesce(*[F.when(~F.coalesce(gate, F.lit(False)), F.lit(reason)) for gate, reason in zip(gates, v.GATE_REASONS)], F.lit(""))


@js.bound
def verify_plant(hint: Column, query: Column, title: Column, url: Column, snippets: Column) -> Column:
    """What the text-driven verifier says of a candidate: a struct of its gates, reason and findings.

    The text is all of the candidate's parts, one a line; null and empty parts are left out. The
    findings (facility, products, names of plants, equipment) are empty unless it qualifies.
    """
    company = F.btrim(F.coalesce(hint, F.lit("")))
    some = F.coalesce(snippets, F.array().cast("array<string>"))
    none = F.array().cast("array<string>")

    def found(text: Column) -> Column:
        def of_place(place: Column) -> Column:
            city, plants = place["city"], place["plants"]
            facility = F.struct(
                F.when(city != "", F.concat(city, F.lit(" production facility"))).otherwise("confirmed production facility").alias("name"), place["address"].alias("address"),
                city.alias("city"), js.first(text, v.PLANT_PHONE).alias("phone"), F.coalesce(url, F.lit("")).alias("source_url"), F.get(plants, F.lit(0)).alias("facility_type"),
            )
            useful = F.get(F.filter(some, lambda s: js.test(s, v.USEFUL_SNIPPET)), F.lit(0))
            equipment = F.coalesce(*[F.when(js.test(place["low"], pattern, ""), F.array(*map(F.lit, words))) for pattern, words in v.EQUIPMENT])
            return F.struct(
                F.coalesce(useful, first_of(title, hint)).alias("evidence"), facility.alias("facility"), _named(place["low"], v.END_PRODUCTS, v.ANY_PRODUCT).alias("end_products"),
                plants.alias("production_related_names"), equipment.alias("likely_equipment"),
            )

        def place(address: Column) -> Column:
            city = F.btrim(js.first(address, r",\s*([A-Za-z .'-]+),\s*(?:ON|Ontario)\b", 1))
            plants = js.let(F.lower(text), lambda low: F.struct(low.alias("low"), _named(low, v.PLANT_NAMES, v.ANY_PLANT).alias("plants")))
            return js.let(F.struct(address.alias("address"), city.alias("city"), plants.alias("p")), lambda x: F.struct(x["address"], x["city"], x["p"]["low"].alias("low"), x["p"]["plants"].alias("plants")))

        return js.let(js.let(js.first(text, v.PLANT_ADDRESS + r"[^.\n]*"), place), of_place)

    def told(seen: Column) -> Column:
        real, in_range, text = seen["real"], seen["in_range"], seen["text"]
        operator = real & seen["operates"]
        makes = operator & seen["makes"]
        industrial = makes & seen["scale"]
        qualified = industrial & in_range
        gates = (qualified, real, operator, in_range, makes, industrial)
        names = ("qualified", "is_real_company", "is_plant_operator", "facility_in_range", "manufactures_or_processes", "industrial_scale")
        reason = F.when(qualified, "").otherwise(default_reason(real, operator, in_range, makes, industrial, qualified))
        return F.struct(*[g.alias(k) for g, k in zip(gates, names)], reason.alias("reject_reason"), F.when(qualified, found(text)).alias("found"))

    def seen(text: Column) -> Column:
        return F.struct(
            text.alias("text"), ((company != "") & ~js.test(company, v.PAGE_NAME) & ~js.test(text, v.PAGE_TEXT)).alias("real"), js.test(text, v.PLANT_ADDRESS + r"\b").alias("in_range"),
            (js.test(text, v.OPERATES) & ~js.test(text, v.VENDOR)).alias("operates"), js.test(text, v.MAKES).alias("makes"), js.test(text, v.SCALE).alias("scale"),
        )

    def shaped(t: Column) -> Column:
        gates = ("qualified", "is_real_company", "is_plant_operator", "facility_in_range", "manufactures_or_processes", "industrial_scale", "reject_reason")
        lists = ("end_products", "production_related_names", "likely_equipment")
        return F.struct(
            *[t[k].alias(k) for k in gates], F.when(t["qualified"], "medium").otherwise("low").alias("confidence"), *[t["found"][k].alias(k) for k in ("evidence", "facility")],
            *[F.coalesce(t["found"][k], none).alias(k) for k in lists],
        )

    # Texts, gates and findings are worked out once each, however many columns read them.
    return js.let(js.let(js.let(candidate_text(hint, query, title, url, snippets), seen), told), shaped)


#: What a model's answer is read as, whatever else it holds.
ANSWER = (
    "qualified boolean, is_real_company boolean, is_plant_operator boolean, facility_in_range boolean, manufactures_or_processes boolean, "
    "industrial_scale boolean, reject_reason string, confidence string, "
    "proof array<struct<claim: string, source_type: string, source_url: string, evidence: string>>, "
    "confirmed_facilities array<struct<name: string, address: string, city: string, phone: string, source_url: string, facility_type: string>>, "
    "end_products array<string>, production_related_names array<string>, likely_equipment array<string>"
)


def read_answer(answer: Column) -> Column:
    """A model's JSON answer in its closed shape; an answer that can't be read has nothing.

    Missing tests are false, an unknown confidence is low, entries without content are left out.
    It stays qualified only if all five tests hold and it has proof, facilities and products.
    """
    return js.let(F.from_json(answer, ANSWER), _closed)


def _closed(raw: Column) -> Column:
    text = lambda x: js.trim(x)
    flag = lambda name: F.coalesce(raw[name], F.lit(False))
    texts = lambda name: F.filter(F.transform(F.coalesce(raw[name], F.array().cast("array<string>")), text), lambda x: x != "")

    def rows(name: str, fields: tuple[str, ...], needed: tuple[str, ...]) -> Column:
        shaped = F.transform(F.coalesce(raw[name], F.array()), lambda r: F.struct(*[text(r[f]).alias(f) for f in fields]))
        return F.filter(shaped, lambda r: F.concat(*[r[f] for f in needed]) != "")

    tests = ("is_real_company", "is_plant_operator", "facility_in_range", "manufactures_or_processes", "industrial_scale")
    proof = rows("proof", ("claim", "source_type", "source_url", "evidence"), ("claim", "evidence", "source_url"))
    facilities = rows("confirmed_facilities", ("name", "address", "city", "phone", "source_url", "facility_type"), ("address", "name"))
    products, level = texts("end_products"), F.lower(text(raw["confidence"]))
    flags = F.struct(*[flag(t).alias(t) for t in ("qualified", *tests)])
    read = F.struct(
        flags.alias("flags"), proof.alias("proof"), facilities.alias("facilities"), products.alias("products"), level.alias("level"), text(raw["reject_reason"]).alias("given"),
        texts("production_related_names").alias("names"), texts("likely_equipment").alias("equipment"),
    )

    def judged(r: Column) -> Column:
        proven = (F.size(r["proof"]) > 0) & (F.size(r["facilities"]) > 0) & (F.size(r["products"]) > 0)
        return F.struct(r.alias("r"), default_reason(*[r["flags"][t] for t in tests], proven).alias("reason"))

    def shaped(x: Column) -> Column:
        r, reason, level = x["r"], x["reason"], x["r"]["level"]
        qualified = r["flags"]["qualified"] & (reason == "")
        return F.struct(
            qualified.alias("qualified"), *[r["flags"][t].alias(t) for t in tests],
            F.when(qualified, "").when(reason == "", r["given"]).otherwise(first_of(r["given"], reason)).alias("reject_reason"),
            F.when(level.isin("high", "medium", "low"), level).otherwise("low").alias("confidence"),
            r["proof"].alias("proof"), r["facilities"].alias("confirmed_facilities"), r["products"].alias("end_products"),
            r["names"].alias("production_related_names"), r["equipment"].alias("likely_equipment"),
        )

    return js.let(js.let(read, judged), shaped)


def has_products(text: Column) -> Column:
    low = F.lower(js.clean(text))
    hints = [F.contains(low, F.lit(h)) for h in v.PRODUCT_HINTS]
    return (low != "") & ~(hints[0] | hints[1] | hints[2])


def passes_strict_guard(company: Column, stage: Column, industry: Column, notes: Column, contacts: Column, tags: Column, product: Column) -> Column:
    """Does a saved record still look like a plant: address, phone, plant words, products, and no hint against it?"""
    parts = F.array(company, stage, industry, notes, contacts, tags, product)
    text = F.array_join(F.filter(parts, lambda x: F.coalesce(x, F.lit("")) != ""), " ")
    low = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    against = F.lit(False)
    for hint in (*v.REJECT_HINTS, *v.RANGE_HINTS, *v.PRODUCT_HINTS):
        against = against | F.contains(low, F.lit(hint))
    against = against | js.test(js.clean(stage), r"\bneeds products\b") | js.test(text, v.STRICT_NO_PRODUCT)
    return (js.clean(company) != "") & ~against & js.test(text, v.STRICT_ADDRESS) & js.test(text, v.STRICT_PHONE, "") & js.test(text, v.STRICT_PLANT)


def industry(categories: Column, text: Column) -> Column:
    """The first industry whose words the categories or the text hold."""
    both = F.concat_ws(" ", F.array_join(categories, " "), F.coalesce(text, F.lit("")))
    return F.coalesce(*[F.when(js.test(both, pattern), label) for pattern, label in v.INDUSTRIES], F.lit(v.OTHER_INDUSTRY))


def equipment_fit(bucket: Column, text: Column) -> Column:
    by_bucket = [F.when(js.test(bucket, pattern, ""), sentence) for pattern, sentence in v.EQUIPMENT_FIT]
    return F.coalesce(*by_bucket, F.when(js.test(text, v.PROCESS_TEXT), v.PROCESS_FIT), F.lit(v.NO_FIT))


def food_products(name: Column) -> Column:
    found = F.array_compact(F.array(*[F.when(js.test(name, pattern), label) for label, pattern in v.FOOD_PRODUCTS]))
    return F.when(F.size(found) == 0, F.array(F.lit(v.ANY_FOOD))).otherwise(found)


@js.bound
def census_score(text: Column, categories: Column, products: Column, registered: Column, website: Column, address: Column, description: Column, company: Column) -> Column:
    """(score, reasons) of a profile, with what the registry match and its page add."""
    def tests(text: Column) -> Column:
        noise = js.test(F.concat_ws(" ", company, description), v.ARTISAN) & ~js.test(description, v.STRONG_INDUSTRY)
        return F.array(
            js.test(text, v.MAKER), js.test(text, v.STRONG_INDUSTRY), F.exists(categories, lambda c: js.test(c, v.STRONG_CATEGORY)), F.size(products) >= 2, js.test(text, v.COMMERCIAL),
            js.test(text, v.PROCESS), js.test(text, v.ARTISAN), registered, F.coalesce(website, F.lit("")) != "", js.test(address, v.STREET_ADDRESS), noise,
        )

    def scored(told: Column) -> Column:
        points = (
            (20, "manufacturer language"), (30, "industrial/product keywords"), (16, "target category"), (10, "multiple listed products"), (12, "commercial/bulk signal"),
            (18, "equipment/process signal"), (-24, "small/artisan noise"), (18, "CFIA food licence registry match"), (5, None), (5, None), (-30, "small/artisan noise"),
        )
        reasons = F.array(*[F.when(F.get(told, F.lit(i)), reason) for i, (_, reason) in enumerate(points) if reason])
        return F.struct(_points(*[(F.get(told, F.lit(i)), p) for i, (p, _) in enumerate(points)]).alias("score"), distinct_in_order(reasons).alias("reasons"))

    return js.let(js.let(js.clean(text), tests), scored)


def registry_score(name: Column) -> Column:
    """How much a registered name sounds like a plant."""
    return F.lit(52) + _points((js.test(name, v.REGISTRY_PROCESS), 24), (js.test(name, v.REGISTRY_PRODUCT), 18), (js.test(name, v.REGISTRY_LEGAL), 4), (js.test(js.clean(name), r"^\d+\b"), -8))


def is_closed(stage: Column) -> Column:
    return js.test(js.clean(stage), v.CLOSED_STAGE)


def passes_lead_gate(company: Column, stage: Column, signals: Column, product: Column, tags: Column, wanted: Column) -> Column:
    """May outreach use this company? Food and Beverage asks for words of food plants, other industries for a proper name only."""
    name = js.clean(company)
    bad = (F.length(name) < 2) | js.test(name, r"^[-\s]+") | js.test(name, v.GATE_PAGE_NAME) | js.test(name, r"\.[a-z]{2,}(?:\b|$)") | js.test(name, v.GATE_HEAVY)
    text = F.concat_ws("\n", name, *[F.coalesce(x, F.lit("")) for x in (stage, signals, product, tags)])
    food = F.lower(js.clean(wanted)) == "food and beverage"
    eating = js.test(name, v.GATE_EATING) & ~js.test(name, v.GATE_BREWING)
    retail = js.test(text, v.GATE_RETAIL) & ~js.test(text, v.GATE_INDUSTRIAL)
    return ~bad & (~food | (~eating & js.test(text, v.GATE_FOOD) & ~retail))


def is_own_activity(contact_type: Column, created_by: Column) -> Column:
    """A real activity of a manufacturer: neither a task's mark nor feedback; without a type it is a manufacturer's."""
    by = F.btrim(F.coalesce(created_by, F.lit("")))
    task = by.isin("__task_open", "__task_done") | by.startswith("__task__|")
    return (first_of(contact_type, F.lit("manufacturer")) == "manufacturer") & ~task


@js.bound
def signal(title: Column, snippet: Column, url: Column, named: Column, official: Column) -> Column:
    """(type, role, date) of a search result that tells of hiring or growth; null if it doesn't, or not of this company.

    `named`: does the result name the company? `official`: is it on the company's own host?
    """
    def seen(text: Column) -> Column:
        return F.struct(text.alias("text"), js.test(text, v.SIGNAL_HIRING).alias("hiring"), js.test(text, v.SIGNAL_GROWTH).alias("growth"))

    def roled(s: Column) -> Column:
        role = F.coalesce(*[F.when(js.test(s["text"], pattern), label) for label, pattern in v.SIGNAL_ROLES], F.lit(""))
        return F.struct(s.alias("s"), F.when(s["hiring"], role).otherwise("").alias("role"))

    def labelled(x: Column) -> Column:
        # A text of hiring or growth tells of something, whatever else SIGNAL_INCLUDE names.
        text = x["s"]["text"]
        kind = F.when(js.test(text, v.SIGNAL_PERMIT), "Permit").when(js.test(text, v.SIGNAL_CAPACITY), "Capacity").when(js.test(text, v.SIGNAL_PLANNED), "Planned expansion").otherwise("Expansion")
        label = F.when(x["role"] != "", "Hiring").when(x["s"]["growth"], kind)
        return F.struct(text.alias("text"), x["s"]["hiring"].alias("hiring"), x["role"].alias("role"), label.alias("label"))

    def proven(x: Column) -> Column:
        more = F.struct(x.alias("x"), js.clean(url).alias("url"), js.test(x["text"], v.SIGNAL_ROLE).alias("wanted"), js.first(x["text"], v.SIGNAL_NEW_YEAR).alias("year"))
        return F.when(x["label"].isNotNull(), js.let(more, judged))

    def judged(m: Column) -> Column:
        text, label, hiring, url, wanted, year = m["x"]["text"], m["x"]["label"], m["x"]["hiring"], m["url"], m["wanted"], m["year"]
        stale = js.test(text, v.SIGNAL_OLD_YEAR) & (year == "") & ~js.test(text, v.SIGNAL_CURRENT)
        wrong = (
            js.test(url, r"linkedin\.com/company/") | js.test(text, v.SIGNAL_NEGATIVE) | (~wanted & js.test(text, v.SIGNAL_OTHER_ROLE))
            | (hiring & ~wanted & js.test(url, v.SIGNAL_JOB_BOARD)) | ((label == "Hiring") & ~wanted)
        )
        keep = (url != "") & ~stale & ~wrong & (official | named)
        return F.when(keep, F.struct(label.alias("type"), m["x"]["role"].alias("role"), first_of(js.first(text, v.DATE_HINT), year).alias("date")))

    # What several tests read is worked out once, and the costly ones come last.
    text = F.concat_ws(" ", js.clean(title), js.clean(snippet))
    return js.let(js.let(js.let(js.let(text, seen), roled), labelled), proven)


def names_company(text: Column, hints: Column, key, tokens) -> Column:
    """Does the text hold the key of a hint, of four letters or more, or all of a hint's words of four letters or more, two at least?

    `key` and `tokens` make a text's key and its telling words.
    """
    def every_word(hint: Column, hay: Column) -> Column:
        long_ = F.filter(tokens(hint), lambda w: F.length(w) >= 4)
        return js.let(long_, lambda words: (F.size(words) >= 2) & F.forall(words, lambda w: F.contains(hay, w)))

    def within(x: Column) -> Column:
        hay, hints = x["hay"], x["hints"]
        whole = F.exists(hints, lambda h: js.let(key(h), lambda k: (F.length(k) >= 4) & F.contains(hay, k)))
        return (hay != "") & (whole | F.exists(hints, lambda h: every_word(h, hay)))

    return js.let(F.struct(key(text).alias("hay"), hints.alias("hints")), within)
