"""Price-series operators over all symbols at once: rows (symbol, date, ...), windows by symbol and date.

Frames are of rows, not of days. A rolling mean is null until its frame is full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from ..shipping import ship_package


def by_symbol():
    return Window.partitionBy("symbol").orderBy("date")


def from_end():
    return Window.partitionBy("symbol").orderBy(F.desc("date"))


def so_far():
    return by_symbol().rowsBetween(Window.unboundedPreceding, 0)


def last_rows(n: int, by: str | list[str] = "symbol", order: str = "date"):
    return Window.partitionBy(by).orderBy(order).rowsBetween(-(n - 1), 0)


def full_mean(c: Column | str, n: int, by: str | list[str] = "symbol", order: str = "date") -> Column:
    """Mean of the last n rows, null unless all n are there and not null."""
    w = last_rows(n, by, order)
    return F.when(F.count(c).over(w) == n, F.avg(c).over(w))


def daily_return(close: str = "close", by=None, clip: float | None = None) -> Column:
    r = ratio(close, F.lag(close).over(by or by_symbol())) - 1
    return r if clip is None else F.when(r.isNotNull(), F.greatest(F.least(r, F.lit(clip)), F.lit(-clip)))


def compounded(r: Column | str, by, base: float = 1000.0) -> Column:
    """base times the running product of 1 + r; null r counts as 0. Needs r > -1."""
    return base * F.exp(F.sum(F.log1p(F.coalesce(r if isinstance(r, Column) else F.col(r), F.lit(0.0)))).over(by.rowsBetween(Window.unboundedPreceding, 0)))


#: Parts that the members of an index are dealt into; each gets the index's dates.
PARTS = 64
#: Members of one batch of panel rows.
BATCH = 64


def aligned(bars: DataFrame, membership: DataFrame, parts: int = PARTS) -> DataFrame:
    """Closes of each index on the dates of its members, forward-filled; dates on which a member has none yet go.

    A filled close never goes away again, so these are the dates from the latest first bar of any member on. A member's closes are one row,
    laid out on its index's dates where they lie; rows of the panel are not shuffled, and an index of many members is no single task.
    """
    ship_package(bars.sparkSession)
    members = membership.select("symbol", "index_name")
    own = bars.groupBy("symbol", "date").agg(F.max("close").alias("close"))
    known = F.when(F.col("close").isNotNull(), F.struct(F.unix_date("date").alias("d"), "close"))
    rows = own.groupBy("symbol").agg(F.array_sort(F.collect_list(known)).alias("s"), F.min(F.when(F.col("close").isNotNull(), F.unix_date("date"))).alias("first")).join(members, "symbol")
    begun = rows.groupBy("index_name").agg(F.max("first").alias("start"))
    days = bars.select("symbol", F.unix_date("date").alias("d")).join(members, "symbol").select("index_name", "d").distinct().groupBy("index_name").agg(F.array_sort(F.collect_list("d")).alias("days"))
    days = days.join(begun, "index_name").select("index_name", F.filter("days", lambda d: d >= F.col("start")).alias("days"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    met = rows.withColumn("part", F.pmod(F.xxhash64("symbol"), F.lit(parts)).cast("int")).join(days, ["index_name", "part"]).select("index_name", "symbol", F.col("s.d").alias("d"), F.col("s.close").alias("close"), "days")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, BATCH):
                yield _laid_out(batch.slice(begin, BATCH))

    index, symbol = (membership.schema["index_name"].dataType.simpleString(), bars.schema["symbol"].dataType.simpleString())
    return met.mapInArrow(run, f"index_name {index}, symbol {symbol}, date date, close double")


def _laid_out(members: pa.RecordBatch) -> pa.RecordBatch:
    """One row a member and day of its index: the newest close up to that day."""
    lists = lambda name: [x.values.to_numpy(zero_copy_only=False) for x in members[name]]
    days, closes = lists("days"), []
    for on, d, close in zip(days, lists("d"), lists("close"), strict=True):
        closes.append(close[np.searchsorted(d, on, side="right") - 1] if len(d) else np.full(len(on), np.nan))
    rows = pa.array(np.repeat(np.arange(len(days)), [len(on) for on in days]))
    date = pa.array(np.concatenate(days).astype("int32")).view(pa.date32())
    return pa.RecordBatch.from_arrays([members["index_name"].take(rows), members["symbol"].take(rows), date, pa.array(np.concatenate(closes), from_pandas=True)], ["index_name", "symbol", "date", "close"])


def in_index():
    return Window.partitionBy("index_name", "symbol").orderBy("date")


def equal_weight_index(closes: DataFrame, base: float = 1000.0, clip: float = 0.35) -> DataFrame:
    """index_name, date, ret, level: mean of the members' clipped returns, compounded; the first day stands at base."""
    r = closes.withColumn("r", daily_return("close", in_index(), clip))
    mean = r.groupBy("index_name", "date").agg(F.avg("r").alias("ret"))
    return mean.withColumn("level", compounded("ret", Window.partitionBy("index_name").orderBy("date"), base))


def equal_weight_levels(bars: DataFrame, membership: DataFrame, base: float = 1000.0, clip: float = 0.35) -> DataFrame:
    """equal_weight_index of the aligned closes, found from the bars alone.

    A filled close returns nothing, so a day's mean is the sum of the returns of the members with a bar, over all members. After a close of 0 a
    member has no return up to its next bar: it is taken off the count there. Nothing is made for a member and a date without a bar.
    """
    w = by_symbol()
    own = bars.where("close is not null").groupBy("symbol", "date").agg(F.max("close").alias("close"))
    own = own.select("symbol", "date", daily_return("close", w, clip).alias("r"), (F.lag("close").over(w) == 0).alias("ends"), (F.col("close") == 0).alias("begins"), F.min("date").over(Window.partitionBy("symbol")).alias("first"))
    members = membership.select("symbol", "index_name")
    quiet = bars.where("close is null").select("symbol", "date").distinct()  # dates of an index too
    x = own.unionByName(quiet, allowMissingColumns=True).join(members, "symbol")
    one = lambda c: F.count_if(F.col(c))
    day = x.groupBy("index_name", "date").agg(F.sum("r").alias("total"), one("begins").alias("begins"), one("ends").alias("ends"), F.max("first").alias("first"), F.count_if(F.col("date") == F.col("first")).alias("joined"))
    by, every = Window.partitionBy("index_name").orderBy("date"), Window.partitionBy("index_name")  # one row a date
    # A zero close counts from the day after it up to the day of the next bar.
    day = day.withColumn("off", F.sum(F.col("begins") - F.col("ends")).over(by) - F.col("begins") + F.col("ends"))
    day = day.withColumn("start", F.max("first").over(every)).withColumn("members", F.sum("joined").over(every)).where("date >= start")
    known = F.when(F.col("date") > F.col("start"), F.col("members") - F.col("off"))
    mean = day.select("index_name", "date", ratio(F.coalesce("total", F.lit(0.0)), known).alias("ret"))
    return mean.withColumn("level", compounded("ret", by, base))


def index_filled_both_ways(bars: DataFrame, membership: DataFrame, bench: DataFrame, least_closes: int = 5, least_members: int = 2) -> DataFrame:
    """The other index mode: gaps filled forwards, then backwards, null returns 0, base the first benchmark value; small indices are skipped.

    A filled close returns nothing, so a day's mean is the sum of the returns from close to close over the number of members.
    """
    w = by_symbol()
    closes = bars.where("close is not null").select("symbol", "date", daily_return().alias("r"), F.count("*").over(Window.partitionBy("symbol")).alias("k"))
    own = bars.where("close is null").select("symbol", "date").join(closes.groupBy("symbol").agg(F.max("k").alias("k")), "symbol")  # dates of an index too
    own = closes.unionByName(own, allowMissingColumns=True).where(F.col("k") > least_closes).withColumn("new", F.row_number().over(w) == 1)
    x = own.join(membership.select("symbol", "index_name"), "symbol")
    day = x.groupBy("index_name", "date").agg(F.sum("r").alias("total"), F.count_if("new").alias("new"))
    day = day.withColumn("members", F.sum("new").over(Window.partitionBy("index_name"))).where(F.col("members") >= least_members)
    mean = day.select("index_name", "date", ratio(F.coalesce("total", F.lit(0.0)), "members").alias("ret"))
    start = bench.agg(F.min_by("close", "date").alias("base"))
    w = Window.partitionBy("index_name").orderBy("date")
    log = F.log("base") + F.sum(F.log1p("ret")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return mean.crossJoin(F.broadcast(start)).withColumn("log_level", log).withColumn("level", F.exp("log_level")).drop("base")  # one row


def relative_strength(levels: DataFrame, bench: DataFrame, key: str = "index_name", value: str = "level") -> DataFrame:
    """Ratio to the benchmark on common dates, 100 at the first of them."""
    both = levels.join(bench.select("date", F.col("close").alias("bench")), "date")
    w = Window.partitionBy(key).orderBy("date")
    return both.withColumn("ratio", ratio(value, "bench")).withColumn("rs", ratio(F.col("ratio") * 100, F.first("ratio").over(w)))


def rs_ranking(rs: DataFrame, key: str = "index_name", back: int = 19, value: str = "level", base: float = 1000.0) -> DataFrame:
    """Newest RS less 100, its change over the last `back` points (over all there are, if fewer), status, value, change from base in percent, and rank."""
    w = Window.partitionBy(key).orderBy("date")
    first = F.first("rs").over(w.rowsBetween(Window.unboundedPreceding, 0))
    newest = rs.withColumn("before", F.coalesce(F.lag("rs", back).over(w), first)).withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("date")))).where("rn = 1")
    out = newest.select(key, (F.col("rs") - 100).alias("rs_now"), (F.col("rs") - F.col("before")).alias("trend"), F.col(value).alias("value"), ((F.col(value) / base - 1) * 100).alias("change"))
    status = F.when(F.col("rs_now") >= 0, "Outperforming").otherwise("Underperforming")
    return out.withColumn("status", status).withColumn("rank", F.rank().over(Window.orderBy(F.desc("rs_now"))))  # one row an index


def rs_ratio_momentum(series: DataFrame, bench: DataFrame, n: int, key: str = "index_name", value: str = "level") -> DataFrame:
    """RS-ratio: 100 * ratio / its mean of n; RS-momentum: 100 * RS-ratio / its mean of n."""
    x = relative_strength(series, bench, key, value)
    x = x.withColumn("rs_ratio", ratio(F.col("ratio") * 100, full_mean("ratio", n, key)))
    return x.withColumn("rs_momentum", ratio(F.col("rs_ratio") * 100, full_mean("rs_ratio", n, key)))


def quadrant(x: Column | str, y: Column | str) -> Column:
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    return F.when((x >= 100) & (y >= 100), "Leading").when((x >= 100) & (y < 100), "Weakening").when((x < 100) & (y < 100), "Lagging").otherwise("Improving")


def bucket_end(rule: str) -> Column:
    """The last day of the row's day (D), week ending on Friday (W), month (M) or quarter (Q)."""
    ends = {"D": F.col("date"), "W": F.next_day(F.date_sub("date", 1), "FRI"), "M": F.last_day("date"), "Q": F.last_day(F.add_months(F.date_trunc("quarter", "date"), 2))}
    return ends[rule]


def resampled(series: DataFrame, rule: str, key: str, value: str) -> DataFrame:
    """Last non-null value of each week ending on Friday (W), month (M), quarter (Q), or day (D)."""
    return series.where(F.col(value).isNotNull()).groupBy(key, bucket_end(rule).alias("bucket")).agg(F.max_by(value, "date").alias(value)).withColumnRenamed("bucket", "date")


#: Timeframes of the rotation chart: name, resampling rule, length of the means, points of the tail.
TIMEFRAMES = (("D3", "D", 3, 5), ("D5", "D", 5, 5), ("D10", "D", 10, 8), ("D15", "D", 15, 10), ("W5", "W", 5, 8), ("W10", "W", 10, 10), ("M5", "M", 5, 6), ("Q4", "Q", 4, 4))


def rotation(series: DataFrame, bench: DataFrame, key: str, value: str, timeframes=TIMEFRAMES) -> DataFrame:
    """RS-ratio and momentum of every timeframe, the newest `tail` points of each: timeframe, key, date, age, rs_ratio, rs_momentum, quadrant.

    Every row goes to its bucket under each rule at once, so the series is read once; all means are windows of one partitioning. The
    benchmark, one row a date and rule, goes to the series.
    """
    rules = sorted({rule for _, rule, _, _ in timeframes})

    def by_rule(df: DataFrame, v: str, *keys: str) -> DataFrame:
        bucket = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), bucket_end(r).alias("end")) for r in rules])).alias("b")
        x = df.where(F.col(v).isNotNull()).select(*keys, "date", v, bucket)
        return x.groupBy(*keys, F.col("b.rule").alias("rule"), F.col("b.end").alias("end")).agg(F.max_by(v, "date").alias(v)).withColumnRenamed("end", "date")

    x = by_rule(series, value, key).join(F.broadcast(by_rule(bench.withColumnRenamed("close", "bench"), "bench")), ["rule", "date"]).withColumn("ratio", ratio(value, "bench"))
    own, lengths = [key, "rule"], sorted({n for _, _, n, _ in timeframes})
    back = Window.partitionBy(*own).orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({f"ratio_{n}": ratio(F.col("ratio") * 100, full_mean("ratio", n, own)) for n in lengths})
    x = x.withColumns({f"momentum_{n}": ratio(F.col(f"ratio_{n}") * 100, full_mean(f"ratio_{n}", n, own)) for n in lengths})
    x = x.withColumns({f"age_{n}": F.count(f"momentum_{n}").over(back) for n in lengths})  # points from here to the newest
    shown = lambda rule, n, tail: (F.col("rule") == rule) & F.col(f"momentum_{n}").isNotNull() & (F.col(f"age_{n}") <= tail)
    points = [F.when(shown(rule, n, tail), F.struct(F.lit(name).alias("timeframe"), F.col(f"age_{n}").alias("age"), F.col(f"ratio_{n}").alias("rs_ratio"), F.col(f"momentum_{n}").alias("rs_momentum"))) for name, rule, n, tail in timeframes]
    x = x.select(key, "date", F.explode(F.filter(F.array(*points), lambda p: p.isNotNull())).alias("p"))
    return x.select("p.timeframe", key, "date", "p.age", "p.rs_ratio", "p.rs_momentum", quadrant("p.rs_ratio", "p.rs_momentum").alias("quadrant"))


def true_range() -> Column:
    before = F.lag("close").over(by_symbol())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def atr(bars: DataFrame, n: int = 14, name: str = "atr") -> DataFrame:
    return bars.withColumn("__tr", true_range()).withColumn(name, full_mean("__tr", n)).drop("__tr")


def on_balance_volume() -> Column:
    """Running volume, signed by the day's change; the first day counts 0. Wants a column `diff` of daily changes."""
    return F.sum(F.signum(F.coalesce(F.col("diff"), F.lit(0.0))) * F.col("volume")).over(so_far())


def slope_of_last(df: DataFrame, value: str, n: int, key: str = "symbol", least: int = 5) -> DataFrame:
    """Least-squares slope of the newest n non-null values by key; 0 with fewer than `least`."""
    w = Window.partitionBy(key).orderBy(F.desc("date"))
    x = df.where(F.col(value).isNotNull()).select(key, "date", F.col(value).alias("v")).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
    return x.groupBy(key).agg(F.when(F.count("*") < least, F.lit(0.0)).otherwise(F.regr_slope("v", -F.col("rn"))).alias("slope"), F.count("*").alias("n"))


def fractal_high(k: int, value: str = "high") -> Column:
    """Whether value is the largest of k rows on both sides, all of which are there."""
    w = by_symbol().rowsBetween(-k, k)
    return (F.count(value).over(w) == 2 * k + 1) & (F.col(value) == F.max(value).over(w))


def swing_low(k: int, value: str = "low") -> Column:
    w = by_symbol().rowsBetween(-k, k)
    return (F.count(value).over(w) == 2 * k + 1) & (F.col(value) <= F.min(value).over(w))


def technical_structure(bars: DataFrame, least: int = 200) -> DataFrame:
    """Newest row of each symbol of at least `least` rows: RSI-14 of simple means, 50- and 200-day means, cross, distance, volume trend, trend.

    Volume is rising or falling where its 20-day mean is above 1.3 or below 0.7 of its 50-day mean. The labels of the trend ask for the RSI too.
    """
    x = bars.withColumn("d", F.col("close") - F.lag("close").over(by_symbol())).withColumn("n", F.row_number().over(by_symbol()))
    x = x.withColumn("gain", full_mean(F.greatest("d", F.lit(0.0)), 14)).withColumn("loss", full_mean(F.greatest(-F.col("d"), F.lit(0.0)), 14))
    x = x.withColumn("rsi", F.when(F.col("loss") == 0, 50.0).otherwise(100 - 100 / (1 + ratio("gain", "loss"))))
    x = x.withColumn("ma50", full_mean("close", 50)).withColumn("ma200", full_mean("close", 200))
    x = x.withColumn("share", F.when(full_mean("volume", 50) > 0, ratio(full_mean("volume", 20), full_mean("volume", 50))))
    x = x.withColumn("rn", F.row_number().over(from_end())).where((F.col("rn") == 1) & (F.col("n") >= least))
    above, cross = F.col("close") > F.col("ma200"), F.col("ma50") > F.col("ma200")
    trend = (
        F.when(above & cross & (F.col("rsi") > 50), "STRONG UPTREND").when(above & (F.col("rsi") > 40), "UPTREND")
        .when(~above & ~cross & (F.col("rsi") < 50), "DOWNTREND").when(~above, "WEAK").otherwise("SIDEWAYS")
    )
    volume = F.when(F.col("share").isNull(), "N/A").when(F.col("share") > 1.3, "RISING (accumulation)").when(F.col("share") < 0.7, "FALLING (distribution)").otherwise("NORMAL")
    return x.select("symbol", "date", "rsi", "ma50", "ma200", cross.alias("golden_cross"), ((ratio("close", "ma200") - 1) * 100).alias("vs_200"), volume.alias("volume_trend"), trend.alias("trend"))


def position_signals(bars: DataFrame, bench: DataFrame, least: int = 30) -> DataFrame:
    """Newest row of each symbol of at least `least` closes: distances to 50/100/200-day means and the 52-week high, 3- and 6-month returns
    (64 and 129 rows back), RS, volume spike, down day on high volume.

    RS is the ratio to the benchmark against itself 64 common dates back, times 100. The spike is the volume over its mean of 50 rows; a
    fall in price on more than twice that mean is flagged.
    """
    at = "OVER (PARTITION BY symbol ORDER BY date)"
    x = bars.join(bench.select("date", F.col("close").alias("bench")), "date", "left").withColumn("ratio", ratio("close", "bench")).withColumn("n", F.row_number().over(by_symbol()))
    for n in (50, 100, 200):
        x = x.withColumn(f"ma{n}", full_mean("close", n))
    x = x.withColumn("hi52", F.max("close").over(last_rows(252))).withColumn("ratio_now", F.last("ratio", True).over(so_far()))
    # The newest date may be missing in the benchmark: then the newest common one counts, and dates are counted back from there.
    x = x.withColumn("ratio_3m", F.expr(f"CASE WHEN ratio IS NULL THEN lag(ratio, 65) IGNORE NULLS {at} ELSE lag(ratio, 64) IGNORE NULLS {at} END"))
    for name, back in (("c1", 1), ("c3", 64), ("c6", 129)):
        x = x.withColumn(name, F.lag("close", back).over(by_symbol()))
    x = x.withColumn("v50", full_mean("volume", 50)).withColumn("rn", F.row_number().over(from_end())).where((F.col("rn") == 1) & (F.col("n") >= least))
    gap = lambda c: (ratio("close", c) - 1) * 100
    return x.select(
        "symbol", "close", gap("ma50").alias("vs_50"), gap("ma100").alias("vs_100"), gap("ma200").alias("vs_200"), gap("hi52").alias("vs_52w_high"),
        gap("c3").alias("ret_3m"), gap("c6").alias("ret_6m"), (ratio("ratio_now", "ratio_3m") * 100).alias("rs_3m"),
        ratio("volume", "v50").alias("volume_spike"), F.coalesce((F.col("close") < F.col("c1")) & (F.col("volume") > 2 * F.col("v50")), F.lit(False)).alias("down_volume"),
    )


def breadth(bars: DataFrame, least: int = 50, least_year: int = 200) -> DataFrame:
    """Per date, over symbols of at least `least` closes: shares above the 50- and 200-day means, new 52-week highs and lows within 0.1 %, advances and declines, both ratios.

    A symbol has a 52-week high and low once it has least_year rows.
    """
    year = last_rows(252)
    x = bars.withColumn("all", F.count("close").over(Window.partitionBy("symbol"))).where(F.col("all") >= least)
    x = x.withColumn("ma50", full_mean("close", 50)).withColumn("ma200", full_mean("close", 200)).withColumn("known", F.count("close").over(year) >= least_year)
    x = x.withColumn("hi", F.when(F.col("known"), F.max("close").over(year))).withColumn("lo", F.when(F.col("known"), F.min("close").over(year))).withColumn("before", F.lag("close").over(by_symbol()))
    agg = x.groupBy("date").agg(
        F.count("*").alias("n"), F.count_if(F.col("close") > F.col("ma50")).alias("a50"), F.count("ma50").alias("n50"), F.count_if(F.col("close") > F.col("ma200")).alias("a200"), F.count("ma200").alias("n200"),
        F.count_if(F.col("close") >= F.col("hi") * 0.999).alias("new_highs"), F.count_if(F.col("close") <= F.col("lo") * 1.001).alias("new_lows"),
        F.count_if(F.col("close") > F.col("before")).alias("advances"), F.count_if(F.col("close") < F.col("before")).alias("declines"),
    )
    return agg.select(
        "date", "n", (ratio("a50", "n50") * 100).alias("above_50"), (ratio("a200", "n200") * 100).alias("above_200"), "new_highs", "new_lows", "advances", "declines",
        ratio("new_highs", "new_lows").alias("high_low_ratio"), ratio("advances", "declines").alias("ad_ratio"),
    )


def multi_horizon_alpha(bars: DataFrame, bench: DataFrame, horizons=(21, 63, 126, 252), least: int = 20) -> DataFrame:
    """Returns from the first of the last h common dates to the last against the benchmark's, for symbols of at least `least` of them, their mean (0 without any), and whether it is positive."""
    x = bars.join(bench.select("date", F.col("close").alias("bench")), "date").withColumn("n", F.row_number().over(by_symbol()))
    for h in horizons:
        x = x.withColumn(f"a{h}", ((ratio("close", F.lag("close", h - 1).over(by_symbol())) - 1) - (ratio("bench", F.lag("bench", h - 1).over(by_symbol())) - 1)) * 100)
    x = x.withColumn("rn", F.row_number().over(from_end())).where((F.col("rn") == 1) & (F.col("n") >= least))
    known = F.filter(F.array(*[F.col(f"a{h}") for h in horizons]), lambda v: v.isNotNull())
    mean = ratio(F.aggregate(known, F.lit(0.0), lambda a, v: a + v), F.size(known), 0.0)
    return x.select("symbol", *[f"a{h}" for h in horizons], mean.alias("alpha"), (mean > 0).alias("outperforming"))


def mansfield(bars: DataFrame, bench: DataFrame, n: int = 252) -> DataFrame:
    """Ratio to the benchmark (its last value on or before each date) against its mean of the last n rows, in percent."""
    x = as_of(bars.select("symbol", "date", "close"), bench).withColumn("ratio", ratio("close", "bench")).where("ratio is not null")
    return x.withColumn("mansfield", (ratio("ratio", F.avg("ratio").over(last_rows(n))) - 1) * 100)


def as_of(rows: DataFrame, bench: DataFrame, value: str = "close", name: str = "bench") -> DataFrame:
    """rows with the benchmark's last known value at their date.

    The benchmark, one row a date, is made gapless over dates first, then joined by date: one equi join, no range join.
    """
    b = bench.select("date", F.col(value).alias(name))
    dates = rows.select("date").union(b.select("date")).distinct()
    filled = dates.join(b, "date", "left").withColumn(name, F.last(name, True).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))  # one row a date
    return rows.join(filled, "date", "left")


def higher_lows(bars: DataFrame, k: int = 3, back: int = 50) -> DataFrame:
    """Staircase of swing lows after the lowest low of the last `back` rows: number of record lows on the way up, and whether the last bar still holds above the newest."""
    x = bars.withColumn("rn", F.row_number().over(from_end())).withColumn("is_swing", swing_low(k)).where(F.col("rn") <= back)
    base = x.groupBy("symbol").agg(F.min_by("date", F.col("low")).alias("base_date"), F.min("low").alias("base"), F.max_by("low", "date").alias("last_low"))
    after = x.where("is_swing").join(base, "symbol").where("date > base_date")
    before = F.max("low").over(Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, -1))
    steps = after.withColumn("best", F.greatest(F.coalesce(before, F.col("base")), F.col("base"))).where("low > best")
    counted = steps.groupBy("symbol").agg(F.count("*").alias("steps"), F.max("low").alias("top"))
    return base.join(counted, "symbol", "left").select("symbol", "base", F.coalesce("steps", F.lit(0)).alias("steps"), (F.col("last_low") > F.coalesce("top", "base")).alias("holds"))


def drawdown(nav: Column | str, by) -> Column:
    """nav against its running maximum, 0 or less."""
    return ratio(nav, F.max(nav).over(by.rowsBetween(Window.unboundedPreceding, 0))) - 1
