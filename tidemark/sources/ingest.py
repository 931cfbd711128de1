"""Ingest and sinks: landed rows to declared tables. Bad values become null, never errors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import amount, any_date

BAR_SCHEMA = T.StructType([T.StructField("symbol", T.LongType()), T.StructField("date", T.DateType()), *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")]])
MACRO_SCHEMA = T.StructType([T.StructField("Period", T.StringType()), T.StructField("Value", T.StringType())])


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row a key: the first in the given order."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def normalised_bars(raw: DataFrame) -> DataFrame:
    """Landed bars (symbol, ts, open..volume, ingest_order) to one row a symbol and date: the last ingested; NaN becomes null."""
    clean = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in ("open", "high", "low", "close", "volume")]
    return latest(raw.select("symbol", F.to_date("ts").alias("date"), *clean, "ingest_order"), ["symbol", "date"], F.desc("ingest_order")).select(*BAR_SCHEMA.fieldNames())


def first_source(sources: DataFrame) -> DataFrame:
    """Per symbol the rows of its first source, by priority, that has any close; sources never mix within a symbol."""
    best = sources.where("close is not null").groupBy("symbol").agg(F.min("priority").alias("priority"))
    return sources.join(best, ["symbol", "priority"], "left_semi")


def look_back(df: DataFrame, period: str, end: Column, date: str = "date") -> DataFrame:
    """Rows within `5d`, `3mo`, `10y`, `ytd` or `max` of the end: a plain predicate on the date, so files can be skipped."""
    if period == "max":
        return df.where(F.col(date) <= end)
    if period == "ytd":
        start = F.trunc(end, "year")
    else:
        number, unit = int("".join(c for c in period if c.isdigit())), "".join(c for c in period if c.isalpha())
        start = {"d": F.date_sub(end, number), "wk": F.date_sub(end, 7 * number), "mo": F.add_months(end, -number), "y": F.add_months(end, -12 * number)}[unit]
    return df.where((F.col(date) >= start) & (F.col(date) <= end))


def wide_panel(bars: DataFrame, symbols: list[int], field: str = "close") -> DataFrame:
    """One row a date, one column a symbol; symbols without values stay out. For the edge only: the list is the caller's."""
    x = bars.where(F.col("symbol").isin(symbols) & F.col(field).isNotNull())
    return x.groupBy("date").pivot("symbol", symbols).agg(F.first(field))


def field_panel(bars: DataFrame, symbols: list[int], fields: tuple[str, ...] = ("open", "high", "low", "close", "volume")) -> DataFrame:
    """One row a date on which any of the symbols has bars, and a column field_symbol for each field of each symbol; null where it has none. For the edge only, as wide_panel."""
    of = lambda field, symbol: F.max(F.when(F.col("symbol") == symbol, F.col(field))).alias(f"{field}_{symbol}")
    return bars.where(F.col("symbol").isin(symbols)).groupBy("date").agg(*[of(f, s) for f in fields for s in symbols])


def close_panel(bars: DataFrame, least: int = 30) -> DataFrame:
    counted = bars.withColumn("n", F.count("close").over(Window.partitionBy("symbol")))
    return counted.where(F.col("n") >= least).select("symbol", "date", "close")


def index_definitions(text: DataFrame, column: str = "value") -> DataFrame:
    """JSON {index: {description, constituents[]}} to membership rows."""
    m = F.from_json(column, "map<string,struct<description:string,constituents:array<string>>>")
    return text.select(F.explode(m).alias("index_name", "d")).select("index_name", F.col("d.description").alias("description"), F.explode("d.constituents").alias("symbol"))


def macro_series(spark: SparkSession, folder: str) -> DataFrame:
    """A folder of Period,Value files, one an indicator: its name is the file's. Rows with bad periods or values go."""
    raw = spark.read.csv(folder, header=True, schema=MACRO_SCHEMA).withColumn("indicator", F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:-\d+)?\.csv$", 1))
    return macro_rows(raw)


def macro_rows(raw: DataFrame) -> DataFrame:
    x = raw.select("indicator", F.try_to_timestamp(F.concat(F.trim("Period"), F.lit("-01")), F.lit("yyyy-MM-dd")).cast("date").alias("period"), F.trim("Value").try_cast("double").alias("value"))
    return x.where("period is not null and value is not null")


def records_to_series(records: DataFrame, equal: dict[str, str], period: Column, value: Column, scale: float = 1.0, how: str = "sum") -> DataFrame:
    """Filtered records to one value a period: the sum, the mean, or the last by row order."""
    x = records
    for c, v in equal.items():
        x = x.where(F.col(c) == v)
    x = x.select(period.alias("period"), (value * scale).alias("value"), F.col("seq")).where("period is not null and value is not null")
    agg = {"sum": F.sum("value"), "mean": F.avg("value"), "last": F.max_by("value", "seq")}[how]
    return x.groupBy("period").agg(agg.alias("value"))


POSITION = ("isin", "symbol", "series", "company", "quantity", "avg_cost", "last_price", "invested", "present", "pnl", "source")


def broker_one(raw: DataFrame) -> DataFrame:
    """Broker format 1: the symbol carries a series suffix; invested, present and pnl are worked out."""
    symbol = F.regexp_extract("Symbol", r"^(.*?)(?:-([A-Z]{1,2}))?$", 1)
    series = F.nullif(F.regexp_extract("Symbol", r"^(.*?)(?:-([A-Z]{1,2}))?$", 2), F.lit(""))
    q, a, p = amount("Qty").cast("long"), amount("Avg Price"), amount("LTP")
    x = raw.select(F.col("ISIN").alias("isin"), symbol.alias("symbol"), F.coalesce(series, F.lit("EQ")).alias("series"), q.alias("quantity"), a.alias("avg_cost"), p.alias("last_price"))
    return x.withColumn("invested", F.col("quantity") * F.col("avg_cost")).withColumn("present", F.col("quantity") * F.col("last_price")).withColumn("pnl", F.col("present") - F.col("invested")).withColumn("source", F.lit("one"))


def broker_two(raw: DataFrame, master: DataFrame) -> DataFrame:
    """Broker format 2: names only; the symbol comes from the ISIN master(isin, symbol, series)."""
    x = raw.select(F.col("ISIN").alias("isin"), F.trim("Stock Name").alias("company"), amount("Quantity").cast("long").alias("quantity"), amount("Average buy price").alias("avg_cost"), amount("Closing value").alias("present"))
    x = x.join(master, "isin", "left").withColumn("invested", F.col("quantity") * F.col("avg_cost"))
    return x.withColumn("pnl", F.col("present") - F.col("invested")).withColumn("last_price", F.try_divide("present", "quantity")).withColumn("source", F.lit("two"))


def unified_holdings(one: DataFrame, two: DataFrame) -> DataFrame:
    """Both brokers, one row an ISIN (the first broker wins), largest value first."""
    both = one.unionByName(two, allowMissingColumns=True)
    return latest(both, ["isin"], F.col("source")).orderBy(F.desc("present"), "isin")


def security_master(*lists: DataFrame) -> DataFrame:
    """isin, symbol, series of all lists; the first list that has an ISIN wins."""
    out = lists[0].withColumn("priority", F.lit(0))
    for i, x in enumerate(lists[1:], 1):
        out = out.unionByName(x.withColumn("priority", F.lit(i)), allowMissingColumns=True)
    return latest(out, ["isin"], F.col("priority"), F.col("symbol")).drop("priority")


def option_rows(raw: DataFrame) -> DataFrame:
    """End-of-day option lines, all strings, to the chain: trimmed, cast, open interest from shares to lots rounded half to even."""
    t = lambda c: F.trim(F.col(c))
    x = raw.select(t("TckrSymb").alias("underlying"), any_date("XpryDt").alias("expiry"), t("StrkPric").try_cast("double").alias("strike"), t("OptnTp").alias("type"), t("OpnIntrst").try_cast("double").alias("shares"), t("NewBrdLotQty").try_cast("double").alias("lot"), t("UndrlygPric").try_cast("double").alias("und_price"), t("FinInstrmTp").alias("kind"))
    return x.where(F.col("type").isin("CE", "PE") & F.col("expiry").isNotNull() & F.col("strike").isNotNull()).withColumn("oi", F.bround(F.try_divide("shares", "lot")))


DEAL_NAMES = {"Deal Date": "date", "Scrip Code": "code", "Client Name": "client", "Deal Type": "side", "Quantity": "quantity", "Price": "price"}


def renamed_deals(raw: DataFrame) -> DataFrame:
    """Vendor columns to our names; headers are trimmed and internal columns (leading underscore) go."""
    trimmed = raw.toDF(*[c.strip() for c in raw.columns])
    known = trimmed.withColumnsRenamed({k: v for k, v in DEAL_NAMES.items() if k in trimmed.columns})
    return known.select(*[c for c in known.columns if not c.startswith("_")])


def pipe_lines(lines: DataFrame, header: list[str], column: str = "value") -> DataFrame:
    """Lines split at pipes; those of another width, and repeats of the header, go."""
    parts = F.transform(F.split(column, r"\|"), lambda s: F.trim(s))
    x = lines.select(parts.alias("p")).where(F.size("p") == len(header)).where(F.get("p", F.lit(0)) != header[0])
    return x.select(*[F.get("p", F.lit(i)).alias(h) for i, h in enumerate(header)])


SCREENER = "struct<stock:struct<info:struct<ticker:string,name:string>,advancedRatios:struct<pledge:double,promoter:double>>>"


def screener_rows(raw: DataFrame, column: str = "json") -> DataFrame:
    j = F.from_json(column, SCREENER)
    return raw.select(*[c for c in raw.columns if c != column], j["stock"]["info"]["ticker"].alias("ticker"), j["stock"]["info"]["name"].alias("name"), j["stock"]["advancedRatios"]["pledge"].alias("pledge"), j["stock"]["advancedRatios"]["promoter"].alias("promoter"))


#: Labels of statement lines and our items.
LABELS = {"Sales": "revenue", "Expenses": "cogs", "Net Profit": "net_income", "Profit before tax": "pretax_income", "Equity Capital": "share_capital", "Reserves": "reserves"}


def statement_rows(wide: DataFrame, periods: list[str], scale: float = 1e7) -> DataFrame:
    """A label-by-period table to tidy rows in rupees: trailing-twelve-month columns go, labels map, equity, tax and gross profit are derived."""
    names = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    long = wide.unpivot(["symbol", "label"], [p for p in periods if p != "TTM"], "period", "raw").withColumn("item", names[F.col("label")]).where("item is not null")
    x = long.withColumn("value", F.col("raw").cast("double") * scale).groupBy("symbol", "period").pivot("item", sorted(set(LABELS.values()))).agg(F.first("value"))
    x = x.withColumn("equity", F.col("share_capital") + F.col("reserves")).withColumn("tax", F.col("pretax_income") - F.col("net_income")).withColumn("gross_profit", F.col("revenue") - F.col("cogs"))
    items = [c for c in x.columns if c not in ("symbol", "period")]
    return x.unpivot(["symbol", "period"], items, "item", "value").where("value is not null")


def merged_statements(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Cell by cell: the primary's value, else the secondary's; years and items of either."""
    keys = ["symbol", "item", "period"]
    return primary.withColumnRenamed("value", "a").join(secondary.withColumnRenamed("value", "b"), keys, "full").select(*keys, F.coalesce("a", "b").alias("value"))


def flow_rows(raw: DataFrame) -> DataFrame:
    """Fund-flow lines (day, category, route, buy, sell, net as text): equity on the exchange only, totals out, amounts with parentheses."""
    keep = (F.lower("category") == "equity") & (F.lower("route") == "stock exchange") & ~F.lower(F.coalesce("day", F.lit(""))).contains("total")
    return raw.where(keep).select(any_date("day").alias("date"), *[amount(c).alias(c) for c in ("buy", "sell", "net")]).where("date is not null")


def rightmost_column(headers: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """headers(table_id, idx, level, text): per table the largest idx whose levels together hold all the words.

    A word without a space stands in one level or in none, so a column keeps a bit for each; only words with spaces, which may go on from
    one level to the next, need the texts themselves.
    """
    if len(words) < 63 and not any(" " in w for w in words):
        bits = [F.when(F.contains(F.lower("text"), F.lit(w)), F.lit(1 << i)).otherwise(0).cast("long") for i, w in enumerate(words)]
        mask = reduce(lambda a, b: a.bitwiseOR(b), bits, F.lit(0).cast("long"))
        columns = headers.groupBy("table_id", "idx").agg(F.bit_or(mask).alias("held"))
        return columns.where(F.col("held") == (1 << len(words)) - 1).groupBy("table_id").agg(F.max("idx").alias("idx"))
    joined = headers.groupBy("table_id", "idx").agg(F.lower(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("level", "text"))), lambda s: s["text"]))).alias("all"))  # a few levels a column
    for w in words:
        joined = joined.where(F.contains("all", F.lit(w)))
    return joined.groupBy("table_id").agg(F.max("idx").alias("idx"))


def sector_report(raw: DataFrame) -> DataFrame:
    """(sector, net as text, period, report_date): totals and blanks go."""
    name = F.trim(F.coalesce("sector", F.lit("")))
    return raw.where((name != "") & ~F.lower(name).rlike("total")).select(name.alias("sector"), amount("net").alias("net"), "period", "report_date").where("net is not null")


def offerings(raw: DataFrame, start: Column, end: Column) -> DataFrame:
    return raw.where(F.col("listing").between(start, end) & F.col("series").isin("EQ", "SME") & F.col("symbol").rlike("^[A-Za-z]"))


def newest_n(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("__rn") <= n).drop("__rn")


def write_report(df: DataFrame, path: str, partition: str) -> None:
    """Replace the partitions that df has and leave the others: re-runs don't duplicate."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def write_watchlist(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("overwrite").text(path)


def weeks(names: DataFrame, column: str = "name") -> DataFrame:
    """`Week<N>-<dd><Mon>` names to week number and day and month; others go."""
    x = names.select(column, F.regexp_extract(column, r"^Week(\d+)-(\d{2})([A-Z][a-z]{2})$", 1).alias("w"), F.regexp_extract(column, r"^Week(\d+)-(\d{2})([A-Z][a-z]{2})$", 2).alias("day"), F.regexp_extract(column, r"^Week(\d+)-(\d{2})([A-Z][a-z]{2})$", 3).alias("month"))
    return x.where("w <> ''").withColumn("week", F.col("w").cast("int")).drop("w")
