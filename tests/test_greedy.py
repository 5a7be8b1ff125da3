"""Order-dependent operators against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from sparkquarry.operators import greedy

own = random.Random(4)


def test_walk_of_any_key(spark):
    rows = [(i, f"n{own.randint(0, 25)}", own.choice(["", *[f"l{k}" for k in range(20)]]), "x") for i in range(120)]
    kept, names, links = [], set(), set()
    for i, name, link, _ in rows:
        if name in names or (link and link in links):
            continue
        kept.append(i)
        names.add(name)
        links.add(link)
    table = spark.createDataFrame(rows, "pos long, name string, link string, kind string").repartition(3)
    found = greedy.distinct_by_any_key(table, "pos", {"name": F.col("name"), "link": F.col("link")})
    assert found.columns == table.columns and sorted(r["pos"] for r in found.collect()) == kept
    assert greedy.distinct_by_any_key(table.where("false"), "pos", {"name": F.col("name")}).count() == 0


def is_duplicate(row, known, seen):
    name, address, domain, phone = row
    key = lambda kind, value, index: bool(value) and (kind, value) in index
    both = f"{name}::{address}" if name and address else ""
    if known.get(("name", name)) or known.get(("domain", domain)):
        return True
    for kind, value in (("address", address), ("composite", both)):
        if key(kind, value, known) or key(kind, value, seen):
            return True
    for index in (known, seen):
        if key("name", name, index) and key("domain", domain, index):
            return True
    return not address and any(key(k, x, i) for i in (known, seen) for k, x in (("name", name), ("phone", phone)))


def test_without_duplicates(spark):
    pick = lambda letter, k: own.choice(["", "", *[f"{letter}{i}" for i in range(k)]])
    rows = [(i, pick("n", 25), pick("a", 60), pick("d", 30), pick("p", 30)) for i in range(200)]
    known = {("name", "n3"): False, ("domain", "d1"): False, ("name", "n7"): True, ("domain", "d9"): True, ("address", "a5"): False, ("phone", "p2"): False}
    seen, want = {}, {}
    for pos, *row in rows:
        want[pos] = not is_duplicate(row, known, seen)
        if want[pos]:
            name, address, domain, phone = row
            for kind, value in (("name", name), ("address", address), ("domain", domain), ("phone", phone), ("composite", f"{name}::{address}" if name and address else "")):
                if value:
                    seen[kind, value] = True
    table = spark.createDataFrame(rows, "pos long, name string, address string, domain string, phone string").repartition(3)
    index = spark.createDataFrame([(*k, s) for k, s in known.items()], "kind string, key string, skip boolean")
    found = greedy.without_duplicates(table, index)
    assert {r["pos"]: r["accepted"] for r in found.collect()} == want
    assert 20 < sum(want.values()) < 180


def test_merged_contacts(spark):
    weak = ("unknown", "title not public")
    rows = []
    for i in range(90):
        link = own.choice(["", "https://linkedin.com/in/a/", "https://linkedin.com/in/b", "https://LinkedIn.com/in/c", "https://x.example/1"])
        rows.append((i % 2, i, own.choice(["Jane Doe", "jane  doe", "Bob Roe", "A B", "C D", ""]), own.choice([*weak, "Owner", "Chief", ""]), link, own.choice(["", "s"]), own.choice(["", f"note{i}"])))
    want = {}
    for group in (0, 1):
        merged, index = [], {}
        for g, pos, name, title, link, source, notes in rows:
            if g != group or not name or not title:
                continue
            url = (link or source).lower()
            name_key = "name:" + "".join(ch if ch.isalnum() else " " for ch in name.lower()).strip()
            name_key = " ".join(name_key.split())
            key = "linkedin:" + url.rstrip("/") if "linkedin.com/in/" in url else name_key
            at = index.get(key, index.get(name_key))
            if at is None:
                index[key] = index[name_key] = len(merged)
                merged.append([pos, name, title, link, source, notes])
                continue
            old = merged[at]
            if title != old[2] and old[2] in weak:
                old[2] = title
            for k, value in ((3, link), (4, source), (5, notes)):
                old[k] = old[k] or value
        want |= {m[0]: tuple(m[1:]) for m in merged}
    table = spark.createDataFrame(rows, "group long, pos long, name string, title string, link string, source string, notes string").repartition(3)
    found = greedy.merged_contacts(table, lambda t: t.isin(*weak))
    assert {r["pos"]: (r["name"], r["title"], r["link"], r["source"], r["notes"]) for r in found.collect()} == want


def test_merged_profiles(spark):
    words = ["maple", "north", "steel", "foods", "ridge", "baker", "plastics", "river"]
    rows = []
    for i in range(80):
        w = own.sample(words, own.randint(1, 4))
        rows.append((i, " ".join(w), own.choice(["", "", *[f"h{k}" for k in range(15)]]), w, [f"p{i}", "P1"], [f"c{i % 3}"], ["r"], i % 7))
    merged = []
    jaccard = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    for pos, key, host, w, products, categories, reasons, score in rows:
        for m in merged:
            inside = len(key) > 10 and len(m["key"]) > 10 and (key in m["key"] or m["key"] in key)
            if (host and host == m["host"]) or key == m["key"] or inside or jaccard(w, m["words"]) >= 0.86:
                m["products"] += products
                m["categories"] += categories
                m["score"], m["members"] = max(m["score"], score), m["members"] + 1
                break
        else:
            merged.append({"pos": pos, "key": key, "host": host, "words": w, "products": list(products), "categories": list(categories), "score": score, "members": 1})
    once = lambda x, k: [v for i, v in enumerate(x) if v.lower() not in [y.lower() for y in x[:i]]][:k]
    want = {m["pos"]: (m["key"], m["members"], once(m["products"], 12), once(m["categories"], 8), m["score"]) for m in merged}
    schema = "pos long, key string, host string, words array<string>, products array<string>, categories array<string>, reasons array<string>, score long"
    found = greedy.merged_profiles(spark.createDataFrame(rows, schema).repartition(3))
    assert {r["pos"]: (r["key"], r["members"], r["products"], r["categories"], r["score"]) for r in found.collect()} == want
    assert len(want) < 70


@pytest.mark.parametrize("known", [[], [(1, "Maple Foods"), (2, "Maple Foods Ltd")]])
def test_looked_up(spark, known):
    wanted = spark.createDataFrame([(10, "maple foods"), (11, "Foods Maple Inc"), (12, "none at all"), (13, ""), (14, None)], "id long, company string")
    found = greedy.looked_up(wanted, spark.createDataFrame(known, "id long, company string"))
    assert {tuple(r) for r in found.collect()} == ({(10, 1), (11, 1)} if known else set())


def test_chains_take_few_rounds(spark, monkeypatch):
    """A row shares a key with the one before and the one after only."""
    rounds = []
    before = greedy.cut
    monkeypatch.setattr(greedy, "cut", lambda df, name: rounds.append(name) or before(df, name))
    n = 3000
    rows = [(i * 5, str(i // 2), str((i + 1) // 2)) for i in range(n)]
    kept, seen = [], set()
    for pos, *keys in rows:
        if not any((j, k) in seen for j, k in enumerate(keys) if k):
            kept.append(pos)
            seen |= set(enumerate(keys))
    table = spark.createDataFrame(rows, "pos long, a string, b string")
    found = greedy.distinct_by_any_key(table, "pos", {k: F.col(k) for k in "ab"})
    assert sorted(r["pos"] for r in found.collect()) == kept
    assert rounds.count("walk-state") < 20
