"""Searches for people in phases with budgets: a phase asks only for companies that earlier ones have left short."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkquarry.functions import names as n
from sparkquarry.functions import values as v
from sparkquarry.stored import cut, free

ENOUGH = 3  # contacts of a company


class Phase(NamedTuple):
    """How a phase asks: queries in order, of which so many at most, so many at once; what is asked at once is read at once."""

    name: str
    queries: Callable[[Column, Column], Column]  # of a company's aliases and the keys of the titles found so far
    limit: int
    size: int


def _filled(forms: tuple[str, ...], **values: Column) -> list[Column]:
    made = [F.lit(form) for form in forms]
    for name, value in values.items():
        made = [F.replace(m, F.lit(f"{{{name}}}"), value) for m in made]
    return made


def wide_queries(aliases: Column, titles: Column) -> Column:
    """For each name of a company its people wherever they are listed, whatever they do."""
    return n.distinct_in_order(F.flatten(F.transform(F.slice(aliases, 1, 5), lambda a: F.array(*_filled(v.WIDE_SEARCHES, alias=a)))))


def priority_queries(aliases: Column, titles: Column) -> Column:
    """For each of three names the likeliest places, then each wanted title for each of them."""
    few = F.slice(aliases, 1, 3)
    first = F.flatten(F.transform(few, lambda a: F.array(*_filled(v.PRIORITY_SEARCHES, alias=a))))
    roles = F.array(*[F.lit(t) for t in v.PRIORITY_TITLES])
    each = F.flatten(F.transform(roles, lambda t: F.flatten(F.transform(few, lambda a: F.array(*_filled(v.PRIORITY_TITLE_SEARCHES, alias=a, title=t))))))
    return n.distinct_in_order(F.concat(first, each))


def narrow_queries(aliases: Column, titles: Column) -> Column:
    """For each of six names each title that hasn't been found yet."""
    roles = F.filter(F.array(*[F.lit(t) for t in v.NARROW_TITLES]), lambda t: ~F.array_contains(titles, t))
    each = lambda a: F.flatten(F.transform(roles, lambda t: F.array(*_filled(v.NARROW_SEARCHES, alias=a, title=t))))
    return n.distinct_in_order(F.flatten(F.transform(F.slice(aliases, 1, 6), each)))


def repair_queries(names: Column) -> Callable[[Column, Column], Column]:
    """For each of fourteen persons (an array column) without a title, under each of four names, where titles are told."""

    def queries(aliases: Column, titles: Column) -> Column:
        roles = F.array(*[F.lit(t) for t in v.REPAIR_TITLES])

        def of_pair(person: Column, alias: Column) -> Column:
            by_title = F.flatten(F.transform(roles, lambda t: F.array(*_filled(v.REPAIR_TITLE_SEARCHES, name=person, alias=alias, title=t))))
            return F.concat(F.array(*_filled(v.REPAIR_SEARCHES, name=person, alias=alias)), by_title)

        each = lambda p: F.flatten(F.transform(F.slice(aliases, 1, 4), lambda a: of_pair(p, a)))
        return n.distinct_in_order(F.flatten(F.transform(F.slice(names, 1, 14), each)))

    return queries


#: The budgets of the first three phases.
PHASES = (Phase("wide", wide_queries, 12, 4), Phase("priority", priority_queries, 48, 4), Phase("narrow", narrow_queries, 24, 5))


def phased_search(companies: DataFrame, hits: DataFrame, phases: tuple[Phase, ...] = PHASES, enough: int = ENOUGH) -> tuple[DataFrame, DataFrame]:
    """What is asked for each of `companies` (company, aliases, and columns that phases use) and whom it finds.

    `hits` (query, contact, title) has what a query finds; it may be a cache or what a search
    engine has just answered. A phase asks for companies with fewer than `enough` contacts, and
    nothing that an earlier phase has asked for the company; after each lot of queries it stops
    for a company that then has enough. Returns (company, phase, at, query), `at` counting a phase's queries, and
    (company, phase, contact, title), each contact of a company once, by its first query.
    Companies without aliases ask nothing; null contacts aren't found.
    """
    spark = companies.sparkSession
    told = hits.where("contact IS NOT NULL").groupBy("query", "contact").agg(F.min("title").alias("title"))
    kind = companies.schema["company"].dataType.simpleString()
    asked, known = spark.createDataFrame([], f"company {kind}, phase string, queries array<string>"), spark.createDataFrame([], f"company {kind}, phase string, contact string, title string")
    for phase in phases:
        # What a company asks stays one list, which is only taken apart to meet the hits.
        found = known.groupBy("company").agg(F.count("*").alias("_n"), F.collect_set(n.company_key("title")).alias("_titles"))
        before = asked.groupBy("company").agg(F.flatten(F.collect_list("queries")).alias("_before"))
        short = companies.join(found, "company", "left").where(F.coalesce("_n", F.lit(0)) < enough).join(before, "company", "left")
        none = F.array().cast("array<string>")
        queries = phase.queries(F.col("aliases"), F.coalesce("_titles", none))
        new = F.slice(F.array_except(queries, F.coalesce("_before", none)), 1, phase.limit)
        lists = cut(short.select("company", F.coalesce("_n", F.lit(0)).alias("_n"), new.alias("queries")).where(F.size("queries") > 0), f"asked-{phase.name}")
        lots = lists.select("company", "_n", F.posexplode("queries").alias("at", "query")).withColumn("lot", F.floor(F.col("at") / phase.size).cast("int"))
        met = lots.join(told, "query").join(known.select("company", "contact"), ["company", "contact"], "left_anti")
        first = cut(met.groupBy("company", "contact").agg(F.min(F.struct("at", "lot", "title", "_n")).alias("f")).select("company", "contact", "f.*"), f"found-{phase.name}")
        so_far = F.sum("more").over(Window.partitionBy("company").orderBy("lot"))
        stops = first.groupBy("company", "lot", "_n").agg(F.count("*").alias("more")).withColumn("all", F.col("_n") + so_far).where(F.col("all") >= enough).groupBy("company").agg(F.min("lot").alias("stop"))
        stops = cut(stops, f"stops-{phase.name}")
        read = F.when(F.col("stop").isNull(), F.col("queries")).otherwise(F.slice("queries", F.lit(1), ((F.col("stop") + 1) * phase.size).cast("int")))
        within = first.join(stops, "company", "left").where(F.col("stop").isNull() | (F.col("lot") <= F.col("stop")))
        asked = asked.unionByName(cut(lists.join(stops, "company", "left").select("company", F.lit(phase.name).alias("phase"), read.alias("queries")), "asked"))
        known = known.unionByName(cut(within.select("company", F.lit(phase.name).alias("phase"), "contact", "title"), "known"))
        free(lists, first, stops)
    return asked.select("company", "phase", F.posexplode("queries").alias("at", "query")), known


def asked_and_found(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(company, phase, queries, digest, contacts) of a phased search; digest is of the queries in order."""
    lists = asked.groupBy("company", "phase").agg(F.array_sort(F.collect_list(F.struct("at", "query"))).alias("q"))
    counts = known.groupBy("company", "phase").agg(F.count("*").alias("contacts"))
    both = lists.join(counts, ["company", "phase"], "left")
    text = F.array_join(F.transform("q", lambda x: x["query"]), "\n")
    return both.select("company", "phase", F.size("q").alias("queries"), F.md5(text).alias("digest"), F.coalesce("contacts", F.lit(0)).alias("contacts"))
