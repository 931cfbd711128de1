"""Keyed merges of new rows into kept ones: the newer wins, the older wins, or whole dates are replaced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written


def dedupe(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """First row of each key in an explicit order."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df with the place, from 1, of each row in a total order over the whole table, without one task for it.

    Ranges of the order are sorted on their own; ids tell a row's place in its range, and the ranges before it are added up, one
    number a range. The sorted rows are written to the shared folder, as both looks at them must see the same ranges. A clashing column is replaced.
    """
    ranged = written(df.drop(name).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()), "ranges")
    ranged = ranged.withColumn("__range", F.shiftright("__id", 33))
    counts = ranged.groupBy("__range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))  # one row a range
    offsets = counts.select("__range", F.coalesce(before, F.lit(0)).alias("__before"))
    place = F.col("__before") + F.col("__id").bitwiseAND((1 << 33) - 1) + 1
    return ranged.join(F.broadcast(offsets), "__range").withColumn(name, place).drop("__id", "__range", "__before")


def upsert(kept: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both, the new one where both have a key. Applying it twice changes nothing."""
    both = kept.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return dedupe(both, keys, F.desc("__new")).drop("__new")


def insert_absent(kept: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both, the kept one where both have a key."""
    return kept.unionByName(new.join(kept.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def replace_dates(kept: DataFrame, new: DataFrame, date: str) -> DataFrame:
    """All of the new rows, and the kept rows of dates that the new ones don't have."""
    return kept.join(new.select(date).distinct(), date, "left_anti").unionByName(new, allowMissingColumns=True)


def official_over_provisional(rows: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """Flows of one key: the official row, unless strict, where the row that came first stays for good."""
    return dedupe(rows, keys, F.col("seq") if strict else F.desc("official"), F.col("seq"))
