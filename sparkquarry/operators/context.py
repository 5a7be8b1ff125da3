"""Which texts hold which names: an inverted index of rare letters, the context of search results, and contacts repaired by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkquarry.functions import contacts as c
from sparkquarry.functions import js
from sparkquarry.functions import names as n
from sparkquarry.functions import text as t
from sparkquarry.functions import values as v
from sparkquarry.operators import greedy
from sparkquarry.stored import cut, worked_out

GRAM = 4
LEVELS = ("loose", "strict", "signal")


def _grams(text: Column, size: Column) -> Column:
    """The different pieces of so many letters of a text; none if it is shorter."""
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1))), lambda i: F.substring(text, i, size))
    return F.when(F.length(text) >= size, F.array_distinct(pieces)).otherwise(F.array().cast("array<string>"))


def contained(patterns: DataFrame, texts: DataFrame, *group: str) -> DataFrame:
    """(*group, pattern, text) of the `texts` (text, body) that hold every part of a pattern (pattern, parts), of
    the same values of the `group` columns.

    Parts are found anywhere, as letters. Each different part is looked up by its four letters (fewer, if it has
    fewer) that the fewest texts of its group hold, and texts that hold the same parts are compared with patterns
    once, so no pair without these is formed. Empty parts count for nothing; a pattern without any part is in no
    text. Ids are those of the rows; equal rows match alike.
    """
    sets, of_text = _in_classes(patterns, texts, *group)
    return of_text.join(sets, [*group, "class"]).select(*group, "pattern", "text").distinct()


def _in_classes(patterns: DataFrame, texts: DataFrame, *group: str) -> tuple[DataFrame, DataFrame]:
    """(*group, class, pattern) and (*group, class, text): as `contained`, by classes of texts that hold the same parts."""
    whole = patterns.select(*group, "pattern", F.array_sort(F.array_distinct(F.filter("parts", lambda p: F.coalesce(p, F.lit("")) != ""))).alias("parts")).where(F.size("parts") > 0)
    parts = cut(whole.select(*group, F.explode("parts").alias("part")).distinct(), "parts")
    own = parts.select(*group, "part", F.explode(_grams(F.col("part"), F.least(F.lit(GRAM), F.length("part")))).alias("gram"))
    sizes = [r["size"] for r in own.select(F.length("gram").alias("size")).distinct().collect()]  # four at most
    every = F.flatten(F.array(*[_grams(F.col("body"), F.lit(k)) for k in sizes])) if sizes else F.array().cast("array<string>")
    # By a given number of tasks: texts are few and short, but to cut them up and look parts up in them takes long.
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda rows: rows.repartition(tasks, *group, "text")
    texts = cut(dealt(texts.select(*group, "text", "body").distinct()), "texts")
    each, keys = texts.select(*group, "text", F.explode(every).alias("gram")), [*group, "gram"]
    # Counted where they are, letters of texts aren't shuffled; then only the rarest of each part are looked up.
    counts = each.groupBy(*keys).agg(F.count("*").alias("texts"))
    rarest = own.join(counts, keys).groupBy(*group, "part").agg(F.min(F.struct("texts", "gram")).alias("r"))
    rarest = cut(rarest.select(*group, "part", F.col("r.gram").alias("gram")), "rare-letters")
    maybe = dealt(each.join(rarest, keys)).groupBy(*group, "text").agg(F.collect_list("part").alias("_maybe"))
    held = dealt(texts).join(maybe, [*group, "text"]).select(*group, "text", F.array_sort(F.filter("_maybe", lambda p: F.contains("body", p))).alias("_held"))
    held = cut(held.where(F.size("_held") > 0).withColumn("class", F.md5(F.to_json("_held"))), "held-parts")
    once = held.groupBy(*group, "class").agg(F.first("_held").alias("_held"))
    # A pattern meets the classes that hold the one of its parts that the fewest classes hold.
    of_class = cut(once.select(*group, "class", "_held", F.explode("_held").alias("part")), "parts-of-classes")
    few = of_class.groupBy(*group, "part").agg(F.count("*").alias("classes"))
    wanted = whole.select(*group, "pattern", "parts", F.explode("parts").alias("part")).join(few, [*group, "part"], "left")
    first = wanted.groupBy(*group, "pattern", "parts").agg(F.min(F.struct(F.coalesce("classes", F.lit(0)).alias("classes"), "part"))["part"].alias("part"))
    met = first.join(of_class, [*group, "part"]).where(F.size(F.array_except("parts", "_held")) == 0)
    return met.select(*group, "class", "pattern").distinct(), held.select(*group, "class", "text")


def holding(patterns: DataFrame, texts: DataFrame, *group: str) -> DataFrame:
    """(*group, text) of the `texts` that hold any pattern, each once; as `contained`, without its pairs."""
    sets, of_text = _in_classes(patterns, texts, *group)
    return of_text.join(sets.select(*group, "class").distinct(), [*group, "class"]).select(*group, "text").distinct()


def patterns(companies: DataFrame, level: str) -> DataFrame:
    """(company, parts): what a text must hold to be of a company with `hints` (names of it), any of these lists of parts, whole.

    A hint's key of four letters or more, or all of its telling words of as many letters, two at
    least. "strict" takes the first two hints, "signal" all; "loose" all, and one word alone if it
    has six letters and says more than that something is searched for.
    """
    if level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}")
    known = F.filter(F.coalesce("hints", F.array().cast("array<string>")), lambda h: F.coalesce(h, F.lit("")) != "")
    each = companies.select("company", F.explode(F.slice(known, 1, 2) if level == "strict" else known).alias("hint")).distinct()
    each = worked_out(each, key=n.company_key("hint"), shown=n.shown_name("hint") if level == "loose" else F.col("hint"))
    each = worked_out(each, words=F.filter(n.company_tokens("shown"), lambda w: F.length(w) >= 4))
    alone = (F.size("words") == 1) & (F.length(F.get("words", F.lit(0))) >= 6) & ~F.get("words", F.lit(0)).isin(*v.SEARCH_TALK)
    told = (F.size("words") >= 2) | alone if level == "loose" else F.size("words") >= 2
    both = F.array_compact(F.array(F.when(F.length("key") >= 4, F.array("key")), F.when(told, F.col("words"))))
    return each.select("company", F.explode(both).alias("parts")).distinct()


def haystack(*texts: Column) -> Column:
    """The key of search texts, in which patterns are looked for."""
    return n.company_key(F.concat_ws(" ", *[js.clean(x) for x in texts]))


def in_market(title: Column, snippet: Column, url: Column, city: Column) -> Column:
    """Is a search result of the expected market: by its text, by a Canadian profile, or, off profile pages, by its address?"""
    edge = F.lit(js.java(r"\b"))
    quoted_city = F.regexp_replace(F.coalesce(city, F.lit("")), r"([.*+?^${}()|\[\]\\])", r"\\$1")
    of_city = F.concat(F.lit("(?i)"), edge, F.lit("(?:"), quoted_city, F.lit(")"), edge)
    local = lambda x: js.test(x, rf"\b(?:{v.LOCAL_TERMS})\b") | ((quoted_city != "") & F.regexp_like(x, of_city))
    host, text = t.host(js.clean(url)), F.concat_ws(" ", js.clean(title), js.clean(snippet))
    profile = (host == "linkedin.com") | host.endswith(".linkedin.com")
    return local(text) | F.coalesce(host == "ca.linkedin.com", F.lit(False)) | (~F.coalesce(profile, F.lit(False)) & local(js.clean(url)))


def context_matches(results: DataFrame, companies: DataFrame, level: str = "strict") -> DataFrame:
    """(result, company) of the `results` (result, title, snippet) whose text is of the context of `companies` (company, hints).

    Many companies are looked for in many texts at once: equal patterns and equal texts are
    compared once, and only where a text holds a pattern's rarest letters.
    """
    each, bodies = _looked_for(results, companies, level)
    met = contained(each.select("pattern", "parts").distinct(), bodies.select("text", "body").distinct())
    return met.join(each.select("pattern", "company"), "pattern").join(bodies.select("text", "result"), "text").select("result", "company").distinct()


def _looked_for(results: DataFrame, companies: DataFrame, level: str) -> tuple[DataFrame, DataFrame]:
    """(company, parts, pattern) of companies and (result, body, text) of results; equal patterns and equal texts have one id."""
    each = patterns(companies, level).withColumn("parts", F.array_sort(F.array_distinct("parts")))
    each = cut(each.withColumn("pattern", F.md5(F.concat_ws("\x01", "parts"))), "patterns")
    bodies = cut(worked_out(results, body=haystack(F.col("title"), F.col("snippet"))).where("body <> ''").select("result", "body", F.md5("body").alias("text")), "bodies")
    return each, bodies


def context_counts(results: DataFrame, companies: DataFrame, level: str = "strict") -> DataFrame:
    """(result, companies, company): of how many `companies` each of the `results` is of the context, and the first of them.

    As context_matches counted, without its pairs: companies of the same patterns, and texts that
    hold the same ones, are classes, and only classes are paired. Results of no company have no row.
    """
    each, bodies = _looked_for(results, companies, level)
    held, of_text = _in_classes(each.select("pattern", "parts").distinct(), bodies.select("text", "body").distinct())
    # Texts may hold different parts and yet the same patterns.
    sets = held.groupBy("class").agg(F.array_sort(F.collect_set("pattern")).alias("_set"))
    sets = cut(sets.withColumn("_same", F.md5(F.array_join("_set", ","))), "pattern-sets")
    of_company = each.groupBy("company").agg(F.array_sort(F.collect_set("pattern")).alias("_all"))
    kinds = cut(of_company.groupBy("_all").agg(F.count("*").alias("n"), F.min("company").alias("first")).withColumn("kind", F.monotonically_increasing_id()), "company-kinds")
    asked = cut(sets.groupBy("_same").agg(F.first("_set").alias("_set")).withColumn("set", F.monotonically_increasing_id()), "asked-sets")
    # Dealt by sets before they meet kinds: pairs are then counted where they are made.
    tasks = int(results.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each_set = asked.select("set", F.explode("_set").alias("pattern")).repartition(tasks, "set")
    pairs = each_set.join(kinds.select("kind", "n", "first", F.explode("_all").alias("pattern")), "pattern").select("set", "kind", "n", "first").distinct()
    counts = pairs.groupBy("set").agg(F.sum("n").alias("companies"), F.min("first").alias("company")).join(asked.select("set", "_same"), "set")
    told = of_text.join(sets.select("class", "_same"), "class").join(counts, "_same").select("text", "companies", "company")
    return bodies.select("text", "result").distinct().join(told, "text").select("result", "companies", "company")


def _in_context(results: DataFrame, own: DataFrame, **bodies: str) -> DataFrame:
    """`results` plus a boolean for each of `bodies` (its name = level:column): does that text hold any pattern of the
    level of its group, of `own` (level, group, pattern, parts)? Equal texts of a group are compared once, by the index."""
    of = {flag: body.split(":") for flag, body in bodies.items()}
    each = F.explode(F.array(*[F.struct(F.lit(level).alias("level"), F.col(column).alias("body")) for level, column in of.values()]))
    texts = results.select("group", each.alias("x")).select("x.level", "group", "x.body").where("body <> ''")
    held = cut(holding(own, texts.withColumn("text", F.col("body")), "level", "group"), "texts-in-context")
    for flag, (level, column) in of.items():
        of_level = held.where(F.col("level") == level).select("group", F.col("text").alias(column), F.lit(True).alias(flag))
        results = results.join(of_level, ["group", column], "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    return results


def _with_role(results: DataFrame, own: DataFrame) -> DataFrame:
    """`results` (group, title, snippet, url; `own` has the patterns of groups) plus _role, what they tell of a person; empty if nothing wanted."""
    bare = js.sub(js.clean("title"), r"\s*\|\s*LinkedIn\s*$", "", "i")
    whole = F.concat_ws(" ", *[F.nullif(js.clean(x), F.lit("")) for x in ("title", "snippet", "url")])
    steps = worked_out(results, _bare=bare, _said=js.clean("snippet"), _whole=whole)
    parts = js.split("_bare", r"\s+-\s+")
    steps = worked_out(steps, _rest=F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), _body=n.company_key("_whole"), _context=haystack(F.col("_bare"), F.col("_said")))
    steps = cut(worked_out(steps, _named=haystack(F.array_join("_rest", " "))), "results-in-context")
    steps = _in_context(steps, own, _of_name="loose:_named", _of_context="strict:_context")
    # Each is asked only where those before it tell nothing.
    none = F.lit("")
    useful = lambda role: js.let(role, lambda x: F.when(c.is_useful_title(x), x).otherwise(""))
    or_else = lambda col, then: F.when(F.col(col) != "", F.col(col)).otherwise(then)
    steps = worked_out(steps, _seen=F.when(F.col("_of_name") | F.col("_of_context"), c.role_in(F.concat_ws(" ", "_bare", "_said"))).otherwise(none))
    steps = worked_out(steps, _own=or_else("_seen", F.when(F.size("_rest") > 0, useful(c.role_text(F.array_join("_rest", " - ")))).otherwise(none)))
    steps = worked_out(steps, _told=or_else("_own", useful(c.role_text(js.first("_said", r"^([^.|]{4,120}?)\s+at\s+", 1)))))
    steps = worked_out(steps, _role=or_else("_told", c.role_in(F.col("_whole"))))
    return worked_out(steps, _wanted=c.is_useful_title(F.col("_role")))


def repaired_contacts(results: DataFrame, candidates: DataFrame, companies: DataFrame) -> DataFrame:
    """Contacts whose role is told by search results: (group, name, title, link, source, notes, result, candidate).

    `results` (group, pos, title, snippet, url) were found for a company, `candidates` (group, pos,
    name, link, source, notes, title) are persons of it, `companies` (group, hints) has its names.
    A candidate meets the results of its group that have its profile link, or whose text holds its
    key; the first by an equality, the second by the key's rarest letters, so no other pairs are
    formed. The result must be of the company's context (loose), not of a role that has ended, and
    tell a wanted role. Of a candidate's rows (by link, else by key) the best scored counts, and so
    among the contacts made: best score first, then in order of results and candidates, none that
    has the name or link of one before. A name of which the key is empty meets results by link only.
    """
    scored = c.contact_score(F.col("title"), F.col("link"), F.col("source"), F.col("notes"))
    who = candidates.select("group", "pos", F.inline(F.array(F.struct(c.person_name(F.col("name")).alias("name"), c.linkedin_url(F.col("link")).alias("link"), js.clean("source").alias("source"), scored.alias("score")))))
    who = worked_out(who.where("name <> ''"), key=n.person_key("name"))
    best = who.where("link <> '' OR key <> ''").groupBy("group", n.first_of(F.col("link"), F.col("key")).alias("_same")).agg(F.min(F.struct((-F.col("score")).alias("rank"), *[F.col(x) for x in ("pos", "name", "link", "source", "key")])).alias("b"))
    people = best.select("group", F.col("b.pos").alias("candidate"), F.col("b.rank").alias("rank"), F.col("b.name").alias("name"), F.col("b.link").alias("link"), F.col("b.source").alias("source"), F.col("b.key").alias("key"))
    named = companies.select(F.col("group").alias("company"), "hints")
    each = [patterns(named, level).select(F.lit(level).alias("level"), F.col("company").alias("group"), F.array_sort(F.array_distinct("parts")).alias("parts")) for level in ("loose", "strict")]
    own = cut(each[0].unionByName(each[1]).distinct().withColumn("pattern", F.md5(F.concat_ws("\x01", "parts"))), "company-patterns")
    now = worked_out(results, _past=c.is_past_role(js.clean("snippet")), _hay=haystack(F.col("title"), F.col("snippet")))
    now = cut(now.where("NOT _past AND _hay <> ''"), "results-of-now")
    told = _in_context(now, own, _loose="loose:_hay").where("_loose")
    told = _with_role(told, own).where("_wanted").select("group", F.col("pos").alias("result"), c.linkedin_url(F.col("url")).alias("profile"), js.clean("url").alias("url"), F.col("_body").alias("body"), F.col("_role").alias("role"))
    told, people = cut(told, "told-roles"), cut(people, "candidates")
    by_link = people.where("link <> ''").join(told, (people["group"] == told["group"]) & (F.col("link") == F.col("profile"))).select(people["group"], "candidate", "result")
    met = contained(people.select("group", F.col("candidate").alias("pattern"), F.array("key").alias("parts")), told.select("group", F.col("result").alias("text"), "body"), "group")
    pairs = by_link.union(met.select("group", F.col("pattern").alias("candidate"), F.col("text").alias("result"))).distinct()
    made = pairs.join(people, ["group", "candidate"]).join(told, ["group", "result"]).select(
        "group", "candidate", "result", "rank", "name", F.col("role").alias("title"), n.first_of(F.col("link"), F.col("profile")).alias("link"),
        n.first_of(F.col("url"), F.col("source")).alias("source"), F.lit("title repaired from public people search").alias("notes"), "key",
    )
    score = c.contact_score(F.col("title"), F.col("link"), F.col("source"), F.col("notes"))
    made = worked_out(made, score=score)
    order = F.struct((-F.col("score")).alias("score"), "result", "rank", "candidate", "group")
    of_group = lambda key: F.when(key != "", F.concat_ws("\x01", F.col("group").cast("string"), key))
    made = cut(made.withColumn("_order", order), "made-contacts")
    kept = greedy.distinct_by_any_key(made, "_order", {"name": of_group(F.col("key")), "link": of_group(F.col("link"))})
    return kept.select("group", "name", "title", "link", "source", "notes", "result", "candidate")


