"""Costly values are worked out once, however many columns and tests read them."""

import pytest
from pyspark.sql import functions as F

from sparkquarry.functions import contacts as c
from sparkquarry.functions import js
from sparkquarry.functions import names as n
from sparkquarry.functions import values as v
from sparkquarry.operators import gates as g
from sparkquarry.operators import rules

ONCE = {
    "F9 plant_verdicts": (lambda A, B, C, D, E: g.verify_plant(A, B, C, D, F.array(E)), (v.OPERATES, v.MAKES, v.SCALE, v.PLANT_PHONE)),
    "F10 recent_signals": (lambda A, B, C, D, E: g.signal(A, B, C, g.names_company(D, F.array(E), n.company_key, n.company_tokens), F.lit(False)), (v.SIGNAL_HIRING, v.SIGNAL_ROLE, v.SIGNAL_PERMIT, v.SIGNAL_NEW_YEAR)),
    "F15 census_scores": (lambda A, B, C, D, E: g.census_score(A, F.array(B), F.array(C), F.lit(True), D, E, B, C), (v.MAKER, v.COMMERCIAL, v.PROCESS, v.STREET_ADDRESS)),
    "F17 company_aliases": (lambda A, B, C, D, E: n.best_aliases(A), (v.JUNK_ALIAS, "[®™©]")),
    "F18 company_keys": (lambda A, B, C, D, E: F.struct(n.domain_key(A), n.phone_dashed(B)), ("^[^/?#]*@", "[^0-9]")),
    "F19 personal_emails": (lambda A, B, C, D, E: rules.personal_addresses(A, B), (r"^(mr|mrs|ms|dr|prof|sir|madam)$", r"[^a-z\s'-]")),
    "F22 signal_classes": (lambda A, B, C, D, E: g.signal(A, B, C, F.lit(True), F.lit(True)), (v.SIGNAL_OTHER_ROLE, v.SIGNAL_ROLE, v.SIGNAL_NEGATIVE)),
    "F23 model_answers": (lambda A, B, C, D, E: g.read_answer(A), ("from_json",)),
    "F14 distinct_contacts": (lambda A, B, C, D, E: c.contact_score(A, B, C, D), (v.STRONG_ROLE, v.WEAK_TITLE, r"linkedin\.com/in/")),
    "F24 profile_contacts": (lambda A, B, C, D, E: c.profile_contact(A, B, C), (r"linkedin\.com/in/", v.PERSON_SHAPE, v.PAST_ROLE)),
}


@pytest.mark.parametrize("name", ONCE)
def test_patterns_stand_in_the_plan_once(spark, name):
    value, patterns = ONCE[name]
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    rows = spark.range(1).select(*[F.lit("x").alias(k) for k in "abcde"])
    plan = rows.select(value(*map(F.col, "abcde")).alias("value"))._jdf.queryExecution().analyzed().toString()
    assert {p: sum(plan.count(js.java(p) + end) for end in "),(") for p in patterns} == dict.fromkeys(patterns, 1)


def test_an_alias_of_the_same_select_is_not_taken_for_an_argument(spark):
    rows = spark.sql("SELECT 'Owner' AS title, 'https://people.example.com/1' AS link")
    told = rows.select(c.linkedin_url(F.col("link")).alias("link"), c.contact_score(F.col("title"), F.col("link"), F.col("link"), F.lit("")).alias("score"))
    alone = rows.select(c.contact_score(F.col("title"), F.col("link"), F.col("link"), F.lit("")).alias("score"))
    assert told.first()["score"] == alone.first()["score"]


def _counted(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def key(x):
        calls.add(1)
        return x

    return calls, key(F.col("id").cast("string"))


def test_f13_keys_of_candidates_are_made_once(spark):
    from sparkquarry.operators.greedy import without_duplicates

    calls, key = _counted(spark)
    rows = spark.range(0, 40, 1, 2).select(F.col("id").alias("pos"), key.alias("name"), *[F.lit("").alias(c) for c in ("address", "domain", "phone")])
    known = spark.createDataFrame([("name", "7", False)], "kind string, key string, skip boolean")
    found = without_duplicates(rows, known).where("NOT accepted").collect()
    assert ([r["pos"] for r in found], calls.value) == ([7], 40)


def test_f16_keys_of_profiles_are_made_once(spark):
    from sparkquarry.operators.greedy import merged_profiles

    calls, key = _counted(spark)
    words = F.array().cast("array<string>")
    rows = spark.range(0, 40, 1, 2).select(F.col("id").alias("pos"), key.alias("key"), F.lit("").alias("host"), *[words.alias(c) for c in ("words", "products", "categories", "reasons")], F.lit(1).alias("score"))
    assert (len(merged_profiles(rows).collect()), calls.value) == (40, 40)
