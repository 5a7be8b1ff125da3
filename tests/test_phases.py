"""Phased searches against a plain walk, and names in the order of a locale."""

import random

from pyspark.sql import functions as F

from sparkquarry.functions import text as t
from sparkquarry.functions import values as v
from sparkquarry.operators import phases as p


def once(items):
    return list(dict.fromkeys(items))


def generators(aliases, titles):
    return {
        "wide": once(f.replace("{alias}", a) for a in aliases[:5] for f in v.WIDE_SEARCHES),
        "priority": once(
            [f.replace("{alias}", a) for a in aliases[:3] for f in v.PRIORITY_SEARCHES]
            + [f.replace("{alias}", a).replace("{title}", x) for x in v.PRIORITY_TITLES for a in aliases[:3] for f in v.PRIORITY_TITLE_SEARCHES]
        ),
        "narrow": once(f.replace("{alias}", a).replace("{title}", x) for a in aliases[:6] for x in v.NARROW_TITLES if x not in titles for f in v.NARROW_SEARCHES),
    }


def walk(aliases, hits):
    """One company: lot by lot until three contacts are known."""
    asked, known = [], {}
    for phase in p.PHASES:
        if len(known) >= p.ENOUGH:
            break
        before = {q for _, _, q in asked}
        queries = [q for q in generators(aliases, {x.lower() for _, x in known.values()})[phase.name] if q not in before][: phase.limit]
        for at in range(0, len(queries), phase.size):
            lot = queries[at : at + phase.size]
            asked += [(phase.name, at + i, q) for i, q in enumerate(lot)]
            for q in lot:
                for contact, title in sorted(hits.get(q, [])):
                    known.setdefault(contact, (phase.name, title))
            if len(known) >= p.ENOUGH:
                break
    return asked, known


def test_phases_equal_a_walk(spark):
    rng = random.Random(7)
    companies = [(i, [f"Co {i}", f"Company {i}", "Shared"][: rng.randint(0, 3)]) for i in range(25)] + [(99, None)]
    hits = {}
    for _, aliases in companies:
        for q in {q for of in generators(aliases or [], set()).values() for q in of}:
            if rng.random() < 0.04:
                hits[q] = [(f"P{rng.randint(0, 40)}", rng.choice(["Owner", "Brewer", "millwright"])) for _ in range(rng.randint(1, 2))]
    for q, found in hits.items():
        hits[q] = sorted({c: x for c, x in reversed(found)}.items())
    table = spark.createDataFrame([(q, *h) for q, found in hits.items() for h in found] + [("x", None, None)], "query string, contact string, title string")
    asked, known = p.phased_search(spark.createDataFrame(companies, "company int, aliases array<string>"), table)
    want = {i: walk(aliases or [], hits) for i, aliases in companies}
    assert sorted(map(tuple, asked.collect())) == sorted((i, *a) for i, (of, _) in want.items() for a in of)
    assert sorted((r["company"], r["contact"], r["phase"]) for r in known.collect()) == sorted((i, c, phase) for i, (_, of) in want.items() for c, (phase, _) in of.items())
    phases_used = {a[0] for of, _ in want.values() for a in of}
    assert phases_used == {"wide", "priority", "narrow"} and sum(len(k) >= p.ENOUGH for _, k in want.values()) > 5


def test_repair_queries(spark):
    row = spark.createDataFrame([(["A", "B"], ["Jo Doe", "Jo Doe"])], "aliases array<string>, names array<string>")
    made = row.select(p.repair_queries(F.col("names"))(F.col("aliases"), F.array().cast("array<string>"))).first()[0]
    assert len(made) == 2 * (6 + 45) and made[0] == '"Jo Doe" "A" LinkedIn' and made[6] == '"Jo Doe" "A" "plant manager"' and made[51] == '"Jo Doe" "B" LinkedIn'


def test_locale_order(spark):
    names = ["Zulu", "éclair", "eclair", "Eclair", "Ècole", "zebra", "Äpfel", "apple", "Apple", "10 Mills", "", "résumé", "resume", "Resume"]
    df = spark.createDataFrame([(x,) for x in names], "name string").repartition(4)
    got = [r[0] for r in df.orderBy(t.locale_order("name")).collect()]
    plain = lambda x: "".join({"é": "e", "è": "e", "ä": "a", "É": "e", "È": "e", "Ä": "a"}.get(c, c) for c in x).lower()
    assert [plain(x) for x in got] == sorted(map(plain, names))
    assert got.index("apple") < got.index("Apple") and got.index("eclair") < got.index("Eclair") < got.index("éclair") and got.index("resume") < got.index("résumé")


def test_f21_queries_are_kept_as_one_list_of_a_company(spark, monkeypatch):
    from sparkquarry.operators import phases

    written = {}
    monkeypatch.setattr(phases, "cut", lambda df, name, cut=phases.cut: written.setdefault(name, []).append(cut(df, name)) or written[name][-1])
    monkeypatch.setattr(phases, "free", lambda *tables: None)
    companies = spark.sql("SELECT id AS company, array(concat('Maple ', id)) AS aliases FROM range(5)")
    asked, _ = phases.phased_search(companies, spark.createDataFrame([("x", "Jane Doe", "Owner")], "query string, contact string, title string"))
    rows = [df.count() for name, of in written.items() if name.startswith("asked") for df in of]
    assert rows == [5] * len(rows) and asked.count() > 5 * len(rows)
