"""Order-aware relational operators: first and best per key, merges, membership, fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of every key in that order; `order` must not tie."""
    row = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_row", row).where("_row = 1").drop("_row")


def first_value_per_key(df: DataFrame, keys: list[str], order: Column, columns: list[str]) -> DataFrame:
    """As first_per_key for few columns: partly aggregated before the shuffle, so a hot key is cheap."""
    held = F.min(F.struct(order.alias("_order"), *columns)).alias("_held")
    return df.groupBy(*keys).agg(held).select(*keys, *[F.col("_held")[c].alias(c) for c in columns])


def latest_non_empty(value: str, at: Column) -> Column:
    """The value, of those that aren't empty, at the latest time."""
    return F.max_by(F.nullif(F.col(value), F.lit("")), at)


def membership(df: DataFrame, known: DataFrame, keys: dict[str, str]) -> DataFrame:
    """A bit per key: does any row of `known` hold the value? `keys` maps a column to its bit's name.

    Bits are independent: two of them may come from different rows of `known`.
    """
    for column, bit in keys.items():
        values = known.select(F.col(column).alias("_key")).where("_key IS NOT NULL").distinct().withColumn(bit, F.lit(True))
        df = df.join(values, F.col(column) == F.col("_key"), "left").drop("_key").withColumn(bit, F.coalesce(bit, F.lit(False)))
    return df


def until_enough(df: DataFrame, keys: list[str], order: list[Column], amount: Column, enough: float) -> DataFrame:
    """Rows in order until the sum of `amount` before a row has reached `enough`."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_before", F.coalesce(F.sum(amount).over(before), F.lit(0.0))).where(F.col("_before") < enough).drop("_before")
