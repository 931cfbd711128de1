"""Fund flows, stakes, option chains and macro series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio


def shift_quarter(quarter_end: Column | str, n: int) -> Column:
    return F.last_day(F.add_months(quarter_end, 3 * n))


def streaks(stakes: DataFrame, as_of: Column) -> DataFrame:
    """Quarters in a row, up to as_of, in which the stake rose; a missing quarter ends it. Only tickers with a row at as_of."""
    w = Window.partitionBy("ticker").orderBy("as_of")
    x = stakes.where(F.col("as_of") <= as_of)
    x = x.withColumn("rose", (F.lag("pct").over(w) < F.col("pct")) & (F.lag("as_of").over(w) == shift_quarter("as_of", -1)))
    # The newest quarter that did not rise, seen from the end, bounds the streak.
    back = Window.partitionBy("ticker").orderBy(F.desc("as_of"))
    x = x.withColumn("age", F.row_number().over(back)).withColumn("newest", F.first("as_of").over(back))
    s = x.groupBy("ticker").agg(F.coalesce(F.min(F.when(~F.coalesce("rose", F.lit(False)), F.col("age"))) - 1, F.count("*")).alias("streak"), F.max("newest").alias("newest"))
    return s.where(F.col("newest") == as_of).select("ticker", "streak")


def stake_changes(stakes: DataFrame, quarters: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """Newest stake of each ticker with its change against the quarters before, by calendar quarter; null where one is missing."""
    out = stakes
    for n in quarters:
        before = stakes.select("ticker", shift_quarter("as_of", n).alias("as_of"), F.col("pct").alias(f"pct_{n}"))
        out = out.join(before, ["ticker", "as_of"], "left").withColumn(f"chg_{3 * n}m", F.col("pct") - F.col(f"pct_{n}")).drop(f"pct_{n}")
    return out


def stake_category(pct: Column, change: Column, streak: Column) -> Column:
    before = F.coalesce(pct, F.lit(0.0)) - F.coalesce(change, F.lit(0.0))
    return F.when(before < 0.05, "New Entry").when(streak >= 4, "4-Quarter Increasing").when(streak == 3, "3-Quarter Increasing").when(streak == 2, "Multi-Quarter Increasing").otherwise("Increased Stake")


def stake_slice(category: Column, streak: Column, pct: Column) -> Column:
    """The one report a row belongs to, or null."""
    new = category == "New Entry"
    return (
        F.when(new & (pct > 1.0), "FII_New_Entry").when(new, None).when(streak >= 4, "FII_4Q_Increasing").when(streak == 3, "FII_3Q_Increasing")
        .when(streak == 2, "FII_2Q_Increasing").when(category == "Increased Stake", "FII_1Q_Increasing")
    )


def investor_change(stakes: DataFrame) -> DataFrame:
    """New Entry or Increased against the quarter before in the table; everything else is left out."""
    w = Window.partitionBy("ticker").orderBy("as_of")
    x = stakes.withColumn("before", F.lag("pct").over(w)).where("pct <> 0")
    flag = F.when(F.col("before").isNull() | (F.col("before") == 0), "New Entry").when(F.col("pct") > F.col("before"), "Increased")
    return x.withColumn("flag", flag).where("flag is not null").withColumn("change", F.col("pct") - F.coalesce("before", F.lit(0.0)))


def backfilled(rows: DataFrame, as_of: Column) -> DataFrame:
    """One row with four changes to up to five quarter rows, none below 0."""
    parts = [F.struct(as_of.alias("as_of"), F.col("pct").alias("pct"))]
    for n in (1, 2, 3, 4):
        parts.append(F.struct(shift_quarter(as_of, -n).alias("as_of"), F.when(F.col(f"chg_{3 * n}m").isNotNull(), F.greatest(F.lit(0.0), F.col("pct") - F.col(f"chg_{3 * n}m"))).alias("pct")))
    return rows.where("pct is not null").select("ticker", F.explode(F.array(*parts)).alias("s")).select("ticker", "s.*").where("pct is not null")


def near_before(rows: DataFrame, key: str, date: str, value: str, low: int, high: int, target: int | None = None) -> DataFrame:
    """rows with `before`: the value of the same key low..high days earlier, the one nearest to target days, else the newest.

    An equi join by key and 32-day bucket, so no range join over all of a key's rows.
    """
    span = 32
    probe = rows.withColumn("b", F.explode(F.sequence(F.floor((F.unix_date(date) - high) / span), F.floor((F.unix_date(date) - low) / span))))
    other = rows.select(F.col(key).alias("k2"), F.col(date).alias("d2"), F.col(value).alias("v2"), F.floor(F.unix_date(date) / span).alias("b2"))
    days = F.datediff(date, "d2")
    met = probe.join(other, (F.col(key) == F.col("k2")) & (F.col("b") == F.col("b2")) & days.between(low, high))
    order = days if target is None else F.abs(days - target) * 1000 + days
    best = met.groupBy(key, date).agg(F.min_by("v2", order).alias("before"))
    return rows.join(best, [key, date], "left")


def row_growth(series: DataFrame, key: str = "indicator", date: str = "period", value: str = "value") -> DataFrame:
    """Changes in percent against 1, 3 and 12 rows before, not calendar months."""
    w = Window.partitionBy(key).orderBy(date)
    return series.select("*", *[((ratio(value, F.lag(value, n).over(w)) - 1) * 100).alias(name) for n, name in ((1, "mom"), (3, "qoq"), (12, "yoy"))])


def nearest_expiry(chain: DataFrame) -> DataFrame:
    return chain.withColumn("first", F.min("expiry").over(Window.partitionBy("underlying"))).where("expiry = first").drop("first")


def monthly_expiries(chain: DataFrame) -> DataFrame:
    """Rows of expiries that are the last of their calendar month."""
    w = Window.partitionBy("underlying", F.trunc("expiry", "MM"))
    return chain.withColumn("last", F.max("expiry").over(w)).where("expiry = last").drop("last")


def max_open_interest(chain: DataFrame) -> DataFrame:
    """Per underlying and expiry: strikes of the largest call and put open interest (lowest strike of ties), totals, put-call ratio."""
    best = lambda kind: F.max_by("strike", F.when(F.col("type") == kind, F.struct("oi", -F.col("strike"))))
    total = lambda kind: F.sum(F.when(F.col("type") == kind, F.col("oi")))
    return chain.groupBy("underlying", "expiry").agg(best("CE").alias("ce_strike"), best("PE").alias("pe_strike"), total("CE").alias("ce_oi"), total("PE").alias("pe_oi"), ratio(total("PE"), total("CE")).alias("pcr"), F.max("und_price").alias("und_price"))


def dividend_history(payments: DataFrame) -> DataFrame:
    """payments(symbol, date, seq, amount): how many, in how many years, total, mean, and the last two against the first two in percent (0 under four payments or where the first two are nothing)."""
    w = Window.partitionBy("symbol")
    x = payments.withColumn("new", F.row_number().over(w.orderBy(F.desc("date"), F.desc("seq")))).withColumn("k", F.count("*").over(w))
    ends = lambda c: F.sum(F.when(c, F.col("amount")).otherwise(0.0))
    x = x.groupBy("symbol").agg(
        F.count("*").alias("payments"), F.count_distinct(F.year("date")).alias("years"), F.sum("amount").alias("total"), F.avg("amount").alias("mean"), ends(F.col("new") <= 2).alias("recent"), ends(F.col("new") > F.col("k") - 2).alias("older"),
    )
    return x.withColumn("growth", F.when((F.col("payments") >= 4) & (F.col("older") > 0), (ratio("recent", "older") - 1) * 100).otherwise(0.0))


def institutional_holders(holders: DataFrame, most: int = 5) -> DataFrame:
    """holders(symbol, holder, kind, pct) to the `most` largest of each kind with the kind's whole percentage and number of holders; ties by holder."""
    w = Window.partitionBy("symbol", "kind")
    x = holders.withColumn("rank", F.row_number().over(w.orderBy(F.desc_nulls_last("pct"), "holder")))
    return x.withColumn("total_pct", F.sum("pct").over(w)).withColumn("holders", F.count("*").over(w)).where(F.col("rank") <= most)


def shareholding_trend(rows: DataFrame, band: float = 1.5) -> DataFrame:
    """rows(ticker, as_of, promoter_pct, public_pct), newest against the quarter and the year (four rows, or all there are) before, for tickers of two rows or more.

    The promoters' trend asks for four rows: the mean of the newest two against that of the oldest two of the newest eight, beyond the band.
    """
    w = Window.partitionBy("ticker")
    x = rows.withColumn("rn", F.row_number().over(w.orderBy(F.desc("as_of")))).withColumn("k", F.count("*").over(w)).where("k >= 2")
    at = lambda c, place: F.max(F.when(F.col("rn") == place, F.col(c)))
    year, eight = F.least(F.lit(5), "k"), F.least(F.lit(8), "k")
    x = x.groupBy("ticker").agg(
        F.max("k").alias("quarters"), at("promoter_pct", 1).alias("promoter"), at("public_pct", 1).alias("public"), (at("promoter_pct", 1) - at("promoter_pct", year)).alias("promoter_1y"), (at("promoter_pct", 1) - at("promoter_pct", 2)).alias("promoter_qoq"),
        (at("public_pct", 1) - at("public_pct", year)).alias("public_1y"), F.avg(F.when(F.col("rn") <= 2, F.col("promoter_pct"))).alias("recent"), F.avg(F.when(F.col("rn").between(eight - 1, eight), F.col("promoter_pct"))).alias("older"),
    )
    trend = F.when((F.col("quarters") >= 4) & (F.col("recent") > F.col("older") + band), "increasing").when((F.col("quarters") >= 4) & (F.col("recent") < F.col("older") - band), "decreasing").otherwise("stable")
    return x.withColumn("trend", trend)
