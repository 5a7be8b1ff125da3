"""Walks in which a row's fate depends on the rows accepted before it, as rounds of joins.

A plain walk would need all rows in one task. Here every round decides each row that can be
decided: it is dropped if the rows accepted so far, that come before it, already make it a
duplicate, and accepted if it wouldn't be one even if all undecided rows before it were
accepted. The first undecided row is always decided, so rounds end. A row that waits for a
single other one is accepted exactly if that one isn't, so it is linked to it; links are joined
end to end, each round doubling their reach, so that a chain of n rows takes about log n rounds.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkquarry.functions import js
from sparkquarry.functions import names as n
from sparkquarry.stored import cut, free


def _held(rows: DataFrame, pos: str, keys: dict[str, Column]) -> DataFrame:
    """(pos, bit, key) of the keys of rows, bit by the order of `keys`; empty and null ones left out."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("bit"), key.alias("key")) for i, key in enumerate(keys.values())]))
    return rows.select(F.col(pos).alias("pos"), each.alias("k")).select("pos", "k.bit", "k.key").where("key <> ''")


def walk(rows: DataFrame, pos: str, keys: dict[str, Column], duplicate: Callable[[dict[str, Column]], Column], more: DataFrame | None = None) -> DataFrame:
    """`rows` plus `accepted`, in the order of `pos` (whole numbers, none twice).

    `keys` names a row's keys, six at most; empty and null ones never match. `duplicate` makes of
    a boolean per key (does an accepted earlier row hold it?) whether the row is a duplicate; it
    may use columns of `rows`, and more of the booleans being true must never make it false.
    `more` (pos, bit, key) adds keys to rows, of the kind that stands at place `bit` of `keys`.

    Rounds are written to spark.checkpoint.dir and deleted when the next one is; a round reads
    undecided rows and their keys only.
    """
    names = list(keys)
    # What `duplicate` says of each set of booleans, as the bits of one number: the rounds need no other columns.
    flag = lambda mask: F.lit(1 << mask if mask < 63 else -(1 << 63)).cast("long")
    says = [F.when(duplicate({k: F.lit(bool(mask >> i & 1)) for i, k in enumerate(names)}), flag(mask)).otherwise(F.lit(0).cast("long")) for mask in range(1 << len(names))]
    truth = reduce(lambda x, y: x.bitwiseOR(y), says)
    told = lambda mask: F.expr(f"shiftright(truth, {mask}) & 1") == 1
    bits = F.bit_or(F.expr("shiftleft(1, bit)"))
    held = _held(rows, pos, keys)
    held = cut((held.unionByName(more) if more is not None else held).distinct(), "walk-keys")
    open_ = cut(rows.select(F.col(pos).alias("pos"), truth.alias("truth"), F.lit(0).alias("sure")), "walk-open")
    decided, jumped, by_link, left = [], None, None, open_.count()
    while left:
        first = held.groupBy("bit", "key").agg(F.min("pos").alias("p1"))
        later = held.join(first, ["bit", "key"]).where("pos > p1")
        after = later.join(later.groupBy("bit", "key").agg(F.min("pos").alias("p2")), ["bit", "key"])
        met = after.groupBy("pos").agg(bits.alias("possible"), F.max(F.expr("pos > p2")).alias("many"), F.min("p1").alias("low"), F.max("p1").alias("high"))
        now = open_.join(met, "pos", "left").withColumn("possible", F.coalesce("possible", F.lit(0)).bitwiseOR(F.col("sure")))
        single = F.when(~F.col("many") & (F.col("low") == F.col("high")), F.col("low"))
        state = cut(now.select("pos", "truth", "sure", F.when(told("sure"), False).when(~told("possible"), True).alias("accepted"), single.alias("waits_for")), "walk-state")
        sure = state.where("accepted IS NOT NULL").select("pos", "accepted")
        # A link: `pos` is accepted exactly if `to` isn't (odd) or exactly if it is.
        chain = state.where("accepted IS NULL AND waits_for IS NOT NULL").select("pos", F.col("waits_for").alias("to"), F.lit(True).alias("odd"))
        ends, spent = sure, [held, open_, state]
        if jumped is not None:
            old = jumped.where("accepted IS NULL").select("pos", "to", "odd").join(sure, "pos", "left_anti")
            chain, ends, spent = old.unionByName(chain.join(old, "pos", "left_anti")), sure.unionByName(by_link), [*spent, jumped]
        onward = chain.select(F.col("pos").alias("to"), F.col("to").alias("_to"), F.col("odd").alias("_odd"))
        twice = chain.join(onward, "to", "left").select("pos", F.coalesce("_to", "to").alias("to"), (F.col("odd") != F.coalesce("_odd", F.lit(False))).alias("odd"))
        ended = twice.join(ends.select(F.col("pos").alias("to"), F.col("accepted").alias("_end")), "to", "left")
        jumped = cut(ended.select("pos", "to", "odd", (F.col("_end") != F.col("odd")).alias("accepted")), "walk-links")
        by_link = jumped.where("accepted IS NOT NULL").select("pos", "accepted")
        found = cut(sure.unionByName(by_link), "walk-decided")
        decided.append(found)
        left -= found.count()
        if left:  # keys of rows accepted now are sure for the open rows after them
            rest = held.join(found, "pos", "left_anti")
            taken = held.join(found.where("accepted"), "pos").groupBy("bit", "key").agg(F.min("pos").alias("taken"))
            new = rest.join(taken, ["bit", "key"]).where("pos > taken").groupBy("pos").agg(bits.alias("new"))
            still = state.join(found, "pos", "left_anti").join(new, "pos", "left")
            open_ = cut(still.select("pos", "truth", F.col("sure").bitwiseOR(F.coalesce("new", F.lit(0))).alias("sure")), "walk-open")
            held = cut(rest, "walk-keys")
        free(*spent)
    if jumped is None:
        free(held, open_)
        return rows.withColumn("accepted", F.lit(None).cast("boolean")).where("false")
    free(jumped)
    all_ = cut(reduce(DataFrame.unionByName, decided), "walk-decided")
    free(*decided)
    return rows.join(all_.select(F.col("pos").alias("_pos"), "accepted"), F.col(pos) == F.col("_pos")).drop("_pos")


def distinct_by_any_key(rows: DataFrame, pos: str, keys: dict[str, Column]) -> DataFrame:
    """The rows of which no earlier kept row holds any key."""
    def any_of(seen: dict[str, Column]) -> Column:
        found = F.lit(False)
        for bit in seen.values():
            found = found | bit
        return found

    return walk(rows, pos, keys, any_of).where("accepted").drop("accepted")


def without_duplicates(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """`candidates` (pos, name, address, domain, phone, all of them keys) plus `accepted`.

    A candidate is dropped if its name or domain is one of `known` (kind, key, skip) marked to
    be skipped; or if known or accepted rows hold its address, its name at its address, both
    its name and its domain (maybe in two rows), or, where it has no address, its name or its
    phone. Kinds are name, address, domain, phone and composite. Only accepted rows count.
    """
    candidates = cut(candidates, "candidate-keys")  # keys take long to make, and every step reads them
    composite = F.when((F.col("name") != "") & (F.col("address") != ""), F.concat("name", F.lit("::"), "address")).otherwise("")
    keys = {"name": F.col("name"), "address": F.col("address"), "domain": F.col("domain"), "phone": F.col("phone"), "composite": composite}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("key")) for k, c in keys.items()]))
    wanted = candidates.select("pos", each.alias("k")).select("pos", "k.kind", "k.key").where("key <> ''")
    known = known.where("key <> ''").groupBy("kind", "key").agg(F.max("skip").alias("skip"))
    bits = wanted.join(known, ["kind", "key"]).groupBy("pos").agg(
        *[F.max(F.when(F.col("kind") == k, F.lit(True))).alias(f"in_{k}") for k in keys],
        F.max(F.when(F.col("kind").isin("name", "domain"), F.col("skip"))).alias("hard"),
    )
    rows = cut(candidates.join(bits.withColumnRenamed("pos", "_of"), F.col("pos") == F.col("_of"), "left").drop("_of"), "candidates")
    no = F.lit(False)
    bit = lambda k: F.coalesce(F.col(f"in_{k}"), no)

    def duplicate(seen: dict[str, Column]) -> Column:
        bare = F.col("address") == ""
        both = (bit("name") & bit("domain")) | (seen["name"] & seen["domain"])
        either = lambda k: bit(k) | seen[k]
        return F.coalesce("hard", no) | either("address") | either("composite") | both | (bare & (either("name") | either("phone")))

    return walk(rows, "pos", keys, duplicate).select(*candidates.columns, "accepted")


def merged_contacts(contacts: DataFrame, weak: Callable[[Column], Column]) -> DataFrame:
    """One row for each person of `contacts` (group, pos, name, title, link, source, notes; cleaned texts).

    Rows without name or title don't count. A row belongs to the earliest accepted one of its
    group that has its profile link, else to the one that has its name; a row that finds neither
    is accepted. Blanks are filled by the first row that has something; the title is the first
    that isn't `weak`, else the last. Returns the columns of `contacts`, pos that of the first row.
    """
    rows = contacts.where("name <> '' AND title <> ''")
    link = F.lower(n.first_of(F.col("link"), F.col("source")))
    profile = F.when(F.contains(link, F.lit("linkedin.com/in/")), F.regexp_replace(link, "/+$", ""))
    person = F.btrim(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", " "))
    of_group = lambda kind, key: F.concat_ws("\x01", F.lit(kind), F.col("group").cast("string"), key)
    by_link, by_name = F.when(profile.isNotNull(), of_group("link", profile)), of_group("name", person)
    rows = rows.withColumn("_link", by_link).withColumn("_name", by_name)
    told = walk(rows, "pos", {"link": F.col("_link"), "name": F.col("_name")}, lambda seen: seen["link"] | seen["name"])
    heads = told.where("accepted")
    of_link = heads.where("_link IS NOT NULL").select(F.col("_link").alias("_k1"), F.col("pos").alias("_h1"))
    of_name = heads.select(F.col("_name").alias("_k2"), F.col("pos").alias("_h2"))
    # One accepted row at most has a key, so these joins match once; a later one with it came too late.
    earlier = lambda h: F.when(F.col(h) < F.col("pos"), F.col(h))
    homed = told.join(of_link, F.col("_link") == F.col("_k1"), "left").join(of_name, F.col("_name") == F.col("_k2"), "left")
    homed = homed.withColumn("_home", F.when(F.col("accepted"), F.col("pos")).otherwise(F.coalesce(earlier("_h1"), earlier("_h2"))))
    filled = lambda c: F.coalesce(F.min_by(c, F.when(F.col(c) != "", F.col("pos"))), F.lit(""))
    title = F.coalesce(F.min_by("title", F.when(~weak(F.col("title")), F.col("pos"))), F.max_by("title", "pos"))
    merged = homed.groupBy("group", "_home").agg(F.min_by("name", "pos").alias("name"), title.alias("title"), *[filled(c).alias(c) for c in ("link", "source", "notes")])
    return merged.select("group", F.col("_home").alias("pos"), "name", "title", "link", "source", "notes")


def _alike_keys(keys: DataFrame, contained: int) -> DataFrame:
    """(a, b) of different keys (column key, each once) one of which, of more than `contained` letters, is part of the
    other; a is the shorter one. What contains a key is found by the rarest eight letters of it."""
    long_ = keys.where(F.length("key") > contained)
    gram = F.transform(F.sequence(F.lit(1), F.length("key") - 7), lambda i: F.substring(F.col("key"), i, F.lit(8)))
    grams = long_.select("key", F.explode(F.array_distinct(gram)).alias("gram"))
    counts = grams.groupBy("gram").count()
    rarest = grams.join(counts, "gram").groupBy("key").agg(F.min(F.struct("count", "gram")).alias("r")).select(F.col("key").alias("a"), F.col("r.gram").alias("gram"))
    return rarest.join(grams, "gram").where((F.col("a") != F.col("key")) & F.contains("key", F.col("a"))).select("a", F.col("key").alias("b"))


def _set_of(words: str) -> Column:
    """A set of words as one text; empty if it has none."""
    return F.concat_ws(" ", F.array_sort(F.array_distinct(words)))


def _alike_sets(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b) of different sets of words (texts in a column set, each once) with a Jaccard similarity of `least` or more."""
    from sparkquarry.operators.matching import jaccard_matches

    sides = [df.where("set <> ''").select(F.col("set").alias("id"), F.split("set", " ").alias("tokens")) for df in (left, right)]
    return jaccard_matches(*sides, least).select(F.col("left_id").alias("a"), F.col("right_id").alias("b")).where("a <> b")


def merged_profiles(profiles: DataFrame, least: float = 0.86, contained: int = 10) -> DataFrame:
    """One row for each company of `profiles` (pos, key, host, words, products, categories, reasons, score).

    In the order of pos a profile joins the first accepted one that it matches, else it is
    accepted. Two match by an equal key or host, by a key of more than `contained` letters inside
    the other's (of more than that, too), or by words with a Jaccard similarity of `least` or more;
    what is empty matches nothing. The accepted row takes the others' products (12 at most),
    categories (8) and reasons, each once, and the highest score.

    Only different keys and different sets of words are compared. Two that are alike become one
    more key, which all their rows hold: rows of equal keys match anyway. So no pairs of rows are
    formed, however many rows a key or host has.
    """
    profiles = cut(profiles, "profiles")  # keys and words take long to make, and every step reads them
    rows = cut(profiles.select("pos", "key", "host", _set_of("words").alias("_set")), "profile-keys")
    keys = {"key": F.col("key"), "host": F.col("host"), "set": F.col("_set")}
    by_key = _alike_keys(rows.select("key").distinct(), contained)
    sets = rows.select(F.col("_set").alias("set")).distinct()
    by_set = _alike_sets(sets, sets, least).where("a < b")
    of_pair = lambda pairs, side: pairs.select(F.col(side).alias("_of"), F.concat_ws("\x01", "a", "b").alias("_pair"))
    both = lambda pairs: of_pair(pairs, "a").unionByName(of_pair(pairs, "b"))
    more = rows.select("pos", "key").join(both(by_key), F.col("key") == F.col("_of")).select("pos", F.lit(0).alias("bit"), F.col("_pair").alias("key"))
    more = more.unionByName(rows.join(both(by_set), F.col("_set") == F.col("_of")).select("pos", F.lit(2).alias("bit"), F.col("_pair").alias("key")))
    more = cut(more, "alike")
    told = cut(walk(rows.select("pos", "key", "host", "_set"), "pos", keys, lambda seen: seen["key"] | seen["host"] | seen["set"], more).select("pos", "accepted"), "accepted")
    # No two accepted rows hold one key, so each key leads to one row at most.
    held = _held(rows, "pos", keys).unionByName(more)
    heads = held.join(told.where("accepted").select("pos"), "pos").select("bit", "key", F.col("pos").alias("head")).distinct()
    joined = held.join(heads, ["bit", "key"]).where("head < pos").groupBy(F.col("pos").alias("_a")).agg(F.min("head").alias("_b"))
    homed = profiles.join(told, "pos").join(joined, F.col("pos") == F.col("_a"), "left").withColumn("home", F.when(F.col("accepted"), F.col("pos")).otherwise(F.col("_b")))
    # Of each list a home keeps the first place of every value, and of these the first ones: no home's rows are gathered whole.
    lists = {"products": 12, "categories": 8, "reasons": None}
    each = homed.select("home", "pos", F.explode(F.array(*[F.struct(F.lit(c).alias("list"), F.col(c).alias("values")) for c in lists])).alias("l"))
    each = each.select("home", "pos", "l.list", F.posexplode("l.values").alias("at", "value")).withColumn("value", js.clean("value")).where("value <> ''")
    once = each.groupBy("home", "list", F.lower("value").alias("_low")).agg(F.min(F.struct("pos", "at", "value")).alias("v"))
    place = F.row_number().over(Window.partitionBy("home", "list").orderBy("v"))
    short = once.where("list <> 'reasons'").withColumn("_place", place).where(F.col("_place") <= 12).drop("_place").unionByName(once.where("list = 'reasons'"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col("list") == c, F.col("v")))), lambda x: x["value"])
    first = lambda c, k: F.slice(ordered(c), 1, k) if k else ordered(c)
    told_lists = short.groupBy(F.col("home").alias("_home")).agg(*[first(c, k).alias(c) for c, k in lists.items()])
    merged = homed.groupBy("home").agg(F.min_by("key", "pos").alias("key"), F.max("score").alias("score"), F.count("*").alias("members"))
    none = F.array().cast("array<string>")
    return merged.join(told_lists, F.col("home") == F.col("_home"), "left").select(
        F.col("home").alias("pos"), "key", "members", *[F.coalesce(c, none).alias(c) for c in lists], "score"
    )


def first_known(profiles: DataFrame, known: DataFrame, least: float = 0.82, contained: int = 8) -> DataFrame:
    """(pos, known_pos) of the first row of `known` that each of `profiles` matches, by pos; both have
    (pos, key, host, words), profiles also `aliases`, other keys of theirs. One word alone is no similarity.

    Of each key, host and set of words only its first known row counts, so rows meet single rows.
    """
    own = profiles.withColumn("_set", F.when(F.size(F.array_distinct("words")) >= 2, _set_of("words")).otherwise("")).withColumn("_alias", F.explode(F.array_union(F.array("key"), F.coalesce("aliases", F.array().cast("array<string>")))))
    first = lambda c: known.where(c != "").groupBy(c.alias("_at")).agg(F.min("pos").alias("known_pos"))
    keys, hosts, sets = cut(first(F.col("key")), "first-keys"), first(F.col("host")), cut(first(_set_of("words")), "first-sets")
    pairs = _alike_keys(keys.select(F.col("_at").alias("key")).union(own.select("key")).where("key <> ''").distinct(), contained)
    pairs = pairs.union(pairs.select("b", "a"))
    inside = pairs.join(keys, F.col("b") == F.col("_at")).groupBy(F.col("a").alias("_at")).agg(F.min("known_pos").alias("known_pos"))
    own_sets = own.select(F.col("_set").alias("set")).where("set <> ''").distinct()
    alike = _alike_sets(own_sets, sets.select(F.col("_at").alias("set")), least).join(sets, F.col("b") == F.col("_at")).groupBy(F.col("a").alias("_at")).agg(F.min("known_pos").alias("known_pos"))
    by = lambda c, table: own.join(table, F.col(c) == F.col("_at")).select("pos", "known_pos")
    found = [by("_alias", keys), by("host", hosts), by("_set", sets), by("key", inside), by("_set", alike)]
    return reduce(DataFrame.union, found).groupBy("pos").agg(F.min("known_pos").alias("known_pos"))


def first_existing(next_: DataFrame, existing: DataFrame, weak: Callable[[Column], Column]) -> DataFrame:
    """(next_pos, existing_pos): the first existing contact (pos, group, name, title, link; keys) that is
    the same as a next one, by link, or by name where the titles are equal or the existing one is weak.

    Of each link, name with title, and name with a weak title only its first existing row counts, so rows meet single rows.
    """
    def by(keys: list[str], held: DataFrame, asked: DataFrame) -> DataFrame:
        first = held.groupBy(*keys).agg(F.min("pos").alias("existing_pos"))
        return asked.select(F.col("pos").alias("next_pos"), *keys).join(first, keys).select("next_pos", "existing_pos")

    linked = F.col("link") != ""
    found = [
        by(["group", "link"], existing.where(linked), next_.where(linked)), by(["group", "name", "title"], existing, next_),
        by(["group", "name"], existing.where(weak(F.col("title"))), next_),
    ]
    return reduce(DataFrame.union, found).groupBy("next_pos").agg(F.min("existing_pos").alias("existing_pos"))


def looked_up(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """(id, known_id): for every wanted company (id, company) a known one (id, company).

    First come those whose name contains the wanted one (from the start of a word on), in any
    case of letters: the one with an equal key, else one of which the words contain the wanted
    one's or the reverse, two at least on each side, else any. Then all others: an equal key, else
    words inside words. Of equals the smallest id. Equal names are compared once.
    """
    first = known.groupBy("company").agg(F.min("id").alias("id"))
    names = cut(_looked_up(wanted.select(F.col("company").alias("id"), "company").distinct(), first), "looked-up")
    return wanted.join(names.withColumnRenamed("id", "company"), "company").select("id", "known_id")


def _looked_up(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """As looked_up, of names each of which is there once; those of `wanted` are their ids."""
    words = lambda c: F.filter(n.company_tokens(c), lambda w: ~w.isin("com", "ca", "www"))
    a = wanted.select("id", n.company_key("company").alias("key"), F.array_distinct(words(F.col("company"))).alias("words"), F.lower("company").alias("low"))
    b = known.select(F.col("id").alias("known_id"), n.company_key("company").alias("k"), F.array_distinct(words(F.col("company"))).alias("w"), F.lower("company").alias("l"))
    a, b = cut(a.where("key <> ''"), "wanted-names"), cut(b.where("k <> ''"), "known-names")
    holds = F.contains(F.col("l"), F.col("low"))
    exact = a.join(b, F.col("key") == F.col("k")).select("id", "known_id", F.when(holds, 0).otherwise(3).alias("rank"))
    # A set inside another shares all its words, its rarest too.
    counts = b.select(F.explode("w").alias("word")).groupBy("word").count()

    def rare(df: DataFrame, own: str, ws: str) -> DataFrame:
        each = df.where(F.size(ws) >= 2).select(F.col(own), F.explode(ws).alias("word")).join(counts, "word", "left")
        return each.groupBy(own).agg(F.min(F.struct(F.coalesce("count", F.lit(0)), F.col("word")))["word"].alias("word"))

    subset = lambda x, y: F.size(F.array_except(x, y)) == 0
    long_a, long_b = a.where(F.size("words") >= 2), b.where(F.size("w") >= 2)
    one = rare(long_a, "id", "words").join(long_b.select("known_id", F.explode("w").alias("word")), "word").select("id", "known_id")
    two = rare(long_b, "known_id", "w").join(long_a.select("id", F.explode("words").alias("word")), "word").select("id", "known_id")
    loose = one.union(two).distinct().join(long_a, "id").join(long_b, "known_id").where(subset(F.col("words"), F.col("w")) | subset(F.col("w"), F.col("words")))
    # A name that holds another from a word's start on has all its words, but for the last, which may go on.
    sure = F.when(F.size("words") > 1, F.slice("words", 1, F.size("words") - 1)).otherwise(F.col("words"))
    each = a.select("id", F.explode(sure).alias("word")).join(counts, "word", "left")
    rarest = each.groupBy("id").agg(F.min(F.struct(F.coalesce("count", F.lit(0)), F.col("word")))["word"].alias("word"))
    held = a.select("id", "low").join(rarest, "id").join(b.select("known_id", "l", F.explode("w").alias("word")), "word")
    inside = held.where(F.contains("l", F.col("low"))).select("id", "known_id", F.lit(2).alias("rank"))
    ranked = exact.union(loose.select("id", "known_id", F.when(holds, 1).otherwise(4).alias("rank"))).union(inside)
    return ranked.groupBy("id").agg(F.min(F.struct("rank", "known_id"))["known_id"].alias("known_id"))


