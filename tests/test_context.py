"""Texts that hold names, against every pair of them."""

import random

import pytest
from pyspark.sql import functions as F

from sparkquarry.operators import context as x


def test_contained_as_by_all_pairs(spark):
    rng = random.Random(2)
    words = ["maple", "foods", "steel", "ste", "el", "a", "meat", "north", "mill", ""]
    patterns = [(i, rng.randint(0, 2), [" ".join(rng.sample(words, rng.randint(1, 2))) for _ in range(rng.randint(0, 3))]) for i in range(120)]
    texts = [(i, rng.randint(0, 2), rng.choice(["", "x", " ".join(rng.choices(words, k=rng.randint(1, 12)))])) for i in range(150)] + [(150, 1, None)]
    has = lambda parts, body: any(parts) and all(p in (body or "") for p in parts if p)
    p = spark.createDataFrame(patterns, "pattern long, g int, parts array<string>").repartition(3)
    t = spark.createDataFrame(texts, "text long, g int, body string").repartition(3)
    assert sorted(map(tuple, x.contained(p, t).collect())) == sorted((i, k) for i, _, parts in patterns for k, _, body in texts if has(parts, body))
    assert sorted(map(tuple, x.contained(p, t, "g").collect())) == sorted((g, i, k) for i, g, parts in patterns for k, h, body in texts if g == h and has(parts, body))
    assert x.contained(p.where("false"), t).count() == 0


LEVELS = [
    # title, snippet, hints, loose, strict, signal
    ("Jane - Maple Leaf Foods", "", ["Maple Leaf"], True, True, True),
    ("Jane - Leaf of Maple", "mapleton leaflet", ["Maple Leaf Inc."], True, True, True),
    ("Jane - Maple", "", ["Maple Leaf"], False, False, False),
    ("Owner at Brewtown", "", ["X", "Y", "Brewtown"], True, False, True),
    ("Hiring now", "", ["The Hiring Group"], False, False, False),
    ("Roasters unite", "", ["Roasters Ltd"], True, False, False),
    ("R &amp; D Mills", "", ["R & D Mills"], True, True, True),
    ("abc", "", ["abc", ""], False, False, False),
    ("", "", ["Maple"], False, False, False),
    ("Maple", "x", None, False, False, False),
]


@pytest.mark.parametrize(("at", "level"), list(enumerate(x.LEVELS)))
def test_levels_of_context(spark, at, level):
    results = spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(LEVELS)], "result int, title string, snippet string")
    companies = spark.createDataFrame([(i, r[2]) for i, r in enumerate(LEVELS)], "company int, hints array<string>")
    met = {tuple(r) for r in x.context_matches(results, companies, level).collect()}
    assert [(i, i) in met for i in range(len(LEVELS))] == [r[3 + at] for r in LEVELS]
    with pytest.raises(ValueError):
        x.patterns(companies, "other")


def test_market(spark):
    rows = [
        ("Plant in Guelph", "", "", "Guelph", True), ("Guelphs", "", "", "Guelph", False), ("ON sale", "", "", "", True), ("once", "", "", "", False), ("a", "GTA-wide", "", None, True),
        ("", "", "https://ca.linkedin.com/in/x", "", True), ("", "", "https://www.linkedin.com/in/toronto", "", False), ("", "", "https://x.example/toronto/", "", True), ("St. John", "", "", "St. J(", False),
    ]
    df = spark.createDataFrame(rows, "title string, snippet string, url string, city string, want boolean")
    assert [r[0] for r in df.select(x.in_market(F.col("title"), F.col("snippet"), F.col("url"), F.col("city"))).collect()] == [r[-1] for r in rows]


def test_repaired_contacts(spark):
    results = [
        (1, 10, "Jane Doe - Plant Manager - Maple Foods | LinkedIn", "", "https://linkedin.com/in/jane?x=1"),
        (1, 11, "Team of Maple Foods", "Robert Roe, head brewer, and Ann Poe", "https://maple.example/team"),
        (1, 12, "Robert Roe - Maple Foods", "Jan 2019 - Mar 2021 Plant Manager", "https://x.example"),
        (1, 13, "Ann Poe - Other Works", "Owner", "https://y.example"),
        (2, 14, "Jane Doe - Owner - Maple Foods", "", "https://z.example"),
        (1, 15, "J. D. - Supervisor - Maple Foods", "", "https://linkedin.com/in/jane/"),
        (1, 16, None, None, None),
    ]
    people = [
        (1, 1, "Jane Doe", "https://linkedin.com/in/jane", "s", "", ""), (1, 2, "jane doe", "", "", "", "Owner"), (1, 3, "Rob Roe - x", "", "src", "", ""), (1, 4, "Sales Team", "", "", "", ""),
        (3, 5, "Ann Poe", "", "", "", ""), (1, 6, None, None, None, None, None),
    ]
    companies = [(1, ["Maple Foods"]), (2, ["Ridge"]), (4, None)]
    made = x.repaired_contacts(
        spark.createDataFrame(results, "group int, pos int, title string, snippet string, url string"),
        spark.createDataFrame(people, "group int, pos int, name string, link string, source string, notes string, title string"),
        spark.createDataFrame(companies, "group int, hints array<string>"),
    )
    assert sorted((r["name"], r["title"], r["link"], r["source"], r["result"], r["candidate"]) for r in made.collect()) == [
        ("Jane Doe", "Plant Manager", "https://linkedin.com/in/jane", "https://linkedin.com/in/jane?x=1", 10, 1),
        ("Rob Roe", "Head Brewer", "", "https://maple.example/team", 11, 3),
    ]
