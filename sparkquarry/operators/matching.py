"""Fuzzy matching of names by the tokens they share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructType


def _prefixes(sets: DataFrame, least: float) -> DataFrame:
    """Each set's rarest tokens, one of which every set that is similar enough must share.

    Of n tokens, a set of similarity `least` shares at least ceil(least * n), so it can't
    lack all of the first n - ceil(least * n) + 1. Common tokens come last and rarely count.
    """
    each = sets.select("id", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    counts = each.groupBy("token").count()
    ordered = each.join(counts, "token").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("count", "token"))).alias("by_count"))
    # Rounding may only lengthen a prefix: 0.28 * 25 is 7.000000000000001 in doubles.
    length = F.col("n") - F.ceil(F.col("n") * F.lit(least) - F.lit(1e-9)).cast("int") + 1
    return ordered.select("id", "n", F.explode(F.slice("by_count", 1, F.least(length, F.col("n")))["token"]).alias("token"))


def jaccard_matches(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(left_id, right_id, similarity) of the rows of two tables (id, tokens) whose token sets have
    a Jaccard similarity of `least` (above 0) or more.

    Tokens of a row are distinct. Equal sets are compared once: rows are grouped by their set
    first, so that many rows of one name cost one comparison. Sets travel as digests; pairs
    whose sizes alone rule them out aren't formed. Rows without tokens match nothing.
    """
    digest = F.md5(F.concat_ws("\x01", "tokens"))
    sides = [side.where(F.size("tokens") > 0).select("id", F.array_sort("tokens").alias("tokens")).withColumn("set", digest) for side in (left, right)]
    sets = sides[0].select("set", "tokens").union(sides[1].select("set", "tokens")).groupBy(F.col("set").alias("id")).agg(F.first("tokens").alias("tokens"))
    short = _prefixes(sets, least)
    a, b = (short.select(*[F.col(c).alias(p + c) for c in ("id", "n", "token")]) for p in "ab")
    met = a.join(b, (F.col("atoken") == F.col("btoken")) & (F.col("aid") <= F.col("bid")) & (F.least("an", "bn") >= F.greatest("an", "bn") * F.lit(least) - F.lit(1e-9)))
    met = met.select("aid", "bid").distinct()
    whole = met.join(sets.select(F.col("id").alias("aid"), F.col("tokens").alias("at")), "aid").join(sets.select(F.col("id").alias("bid"), F.col("tokens").alias("bt")), "bid")
    both = F.size(F.array_intersect("at", "bt"))
    similarity = both / (F.size("at") + F.size("bt") - both)
    close = whole.select(F.col("aid").alias("a"), F.col("bid").alias("b"), F.round(similarity, 6).alias("similarity")).where(similarity >= least)
    back = close.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity")
    keyed = [side.select(F.col("id").alias(name + "_id"), F.col("set").alias(key)) for side, name, key in zip(sides, ("left", "right"), "ab")]
    return close.unionByName(back).join(keyed[0], "a").join(keyed[1], "b").select("left_id", "right_id", "similarity")


def registry_match(rows: DataFrame, registry: DataFrame, least: float, most: int) -> DataFrame:
    """(row_id, registry_id, similarity) of `rows` (id, key, tokens) in `registry` (of the same columns).

    Rows with an equal, non-empty key match exactly, with similarity 1. Only those without any
    exact match are compared by tokens, and have at most the `most` likest matches, ties by id.
    """
    known = registry.where("key <> ''").select(F.col("id").alias("registry_id"), "key")
    exact = rows.join(known, "key").select(F.col("id").alias("row_id"), "registry_id", F.lit(1.0).alias("similarity"))
    rest = rows.join(known.select("key").distinct(), "key", "left_anti")
    fuzzy = jaccard_matches(rest.select("id", "tokens"), registry.select("id", "tokens"), least)
    place = F.row_number().over(Window.partitionBy("left_id").orderBy(F.desc("similarity"), "right_id"))
    best = fuzzy.withColumn("place", place).where(F.col("place") <= most)
    return exact.unionByName(best.select(F.col("left_id").alias("row_id"), F.col("right_id").alias("registry_id"), "similarity"))


def quota_pick(df: DataFrame, groups: dict[str, int], order: list[Column], total: int) -> DataFrame:
    """`total` rows in order, at most so many of each value of the columns in `groups`; what is
    then missing is filled up in order without regard to the caps. Adds `_fill`: came by filling.

    The walk depends on every earlier choice, but of rows alike in all group columns it takes the
    first ones, no more than the least cap. So only these, and the first rows of all, reach the
    task that walks: their number is bounded by the values of the group columns, not by rows.
    Rows must not tie in `order`.
    """
    columns, least = list(groups), min(groups.values())
    alike = F.row_number().over(Window.partitionBy(*columns).orderBy(*order))
    short = df.withColumn("_alike", alike).where(F.col("_alike") <= max(least, 1)).drop("_alike")
    first = df.orderBy(*order).limit(2 * total)
    few = short.unionByName(first).distinct()
    ranked = few.withColumn("_all", F.lit(0)).withColumn("_place", F.row_number().over(Window.partitionBy("_all").orderBy(*order)))

    def walk(rows):
        rows = rows.sort_values("_place", ignore_index=True)
        counts, taken = {c: {} for c in columns}, []
        for i, values in enumerate(zip(*[rows[c] for c in columns])):
            if len(taken) < total and all(counts[c].get(v, 0) < groups[c] for c, v in zip(columns, values)):
                taken.append(i)
                for c, v in zip(columns, values):
                    counts[c][v] = counts[c].get(v, 0) + 1
        chosen = set(taken)
        fill = [i for i in range(len(rows)) if i not in chosen][: total - len(taken)]
        rows["_fill"] = rows.index.isin(fill)
        return rows.loc[sorted(chosen | set(fill))].drop(columns=["_place", "_all"])

    schema = StructType(list(df.schema.fields)).add("_fill", BooleanType())
    return ranked.groupBy("_all").applyInPandas(walk, schema)
