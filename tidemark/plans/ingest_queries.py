"""Queries of ingest, joins, merges and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import joins as J
from ..operators import merge as M
from ..sources import ingest as I
from ..sources.keyed_table import KeyedTable
from ..sources.store import shared_folder
from ..streaming import jobs
from .registry import Registry

R = Registry()
RAW_BARS = lambda t: t.table("lineitem").select(F.col("l_suppkey").alias("symbol"), F.col("l_shipdate").alias("ts"), *[(F.col("l_extendedprice") / F.col("l_quantity")).alias(c) for c in ("open", "high", "low", "close")], F.col("l_quantity").alias("volume"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ingest_order"))
R.add("src_01_bars_ingest", "symbol date close~ volume~", lambda t: I.normalised_bars(RAW_BARS(t)), "SELECT l_suppkey AS symbol, CAST(l_shipdate AS date) AS date, l_extendedprice/l_quantity AS close, l_quantity AS volume FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS date) ORDER BY l_orderkey*10+l_linenumber DESC) = 1")
R.add("src_02_provider_precedence", "symbol priority# n#", lambda t: I.first_source(t.bars.where("symbol % 3 = 0").withColumn("priority", F.lit(1)).unionByName(t.bars.where("symbol % 2 = 0").withColumn("priority", F.lit(2))).unionByName(t.bars.withColumn("priority", F.lit(3)))).groupBy("symbol", "priority").agg(F.count("*").alias("n")), "SELECT symbol, CASE WHEN symbol % 3 = 0 THEN 1 WHEN symbol % 2 = 0 THEN 2 ELSE 3 END AS priority, count(*) AS n FROM bars GROUP BY symbol")


def end_day():
    return F.lit("1998-06-30").cast("date")

R.add("src_03_look_back", "period n#", lambda t: (lambda parts: parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(parts[4]))([I.look_back(t.bars, p, end_day()).groupBy().agg(F.count("*").alias("n")).select(F.lit(p).alias("period"), "n") for p in ("5d", "3mo", "2y", "ytd", "max")]), "SELECT '5d' AS period, count(*) AS n FROM bars WHERE date BETWEEN DATE '1998-06-25' AND DATE '1998-06-30' UNION ALL SELECT '3mo', count(*) FROM bars WHERE date BETWEEN DATE '1998-03-30' AND DATE '1998-06-30' UNION ALL SELECT '2y', count(*) FROM bars WHERE date BETWEEN DATE '1996-06-30' AND DATE '1998-06-30' UNION ALL SELECT 'ytd', count(*) FROM bars WHERE date BETWEEN DATE '1998-01-01' AND DATE '1998-06-30' UNION ALL SELECT 'max', count(*) FROM bars WHERE date <= DATE '1998-06-30'")
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
R.add(
    "src_04_wide_panel",
    "date " + " ".join(f"{r.replace(' ', '_')}~" for r in REGIONS),
    lambda t: I.wide_panel(t.bars.join(t.membership, "symbol").groupBy(F.col("universe").alias("symbol"), "date").agg(F.avg("close").alias("close")), list(REGIONS)).withColumnsRenamed({r: r.replace(" ", "_") for r in REGIONS}),
    "SELECT date, " + ", ".join(f"avg(close) FILTER (universe = '{r}') AS {r.replace(' ', '_')}" for r in REGIONS) + " FROM bars b JOIN membership m ON b.symbol = m.symbol GROUP BY 1",
)
PANEL, PANEL_FIELDS = 5, ("open", "high", "low", "close", "volume")


def most_traded_panel(t):
    """All fields of the most traded symbols, by their rank; the list of symbols is what a caller gives."""
    top = [r.symbol for r in t.bars.groupBy("symbol").agg(F.sum("volume").alias("v")).orderBy(F.desc("v"), "symbol").limit(PANEL).collect()]
    x = I.field_panel(t.bars, top, PANEL_FIELDS)
    return x.select("date", *[F.lit(s).cast("long").alias(f"symbol_{k}") for k, s in enumerate(top, 1)], *[F.col(f"{f}_{s}").alias(f"{f}_{k}") for k, s in enumerate(top, 1) for f in PANEL_FIELDS])


RANKS = range(1, PANEL + 1)
R.add(
    "src_04_symbol_panel",
    "date " + " ".join(f"symbol_{k}#" for k in RANKS) + " " + " ".join(f"{f}_{k}~" for k in RANKS for f in PANEL_FIELDS),
    most_traded_panel,
    "WITH v AS (SELECT symbol, row_number() OVER (ORDER BY sum(volume) DESC, symbol) AS k FROM bars GROUP BY 1 QUALIFY k <= 5) SELECT date, "
    + ", ".join(f"(SELECT symbol FROM v WHERE k = {k}) AS symbol_{k}" for k in RANKS)
    + ", "
    + ", ".join(f"max({f}) FILTER (k = {k}) AS {f}_{k}" for k in RANKS for f in PANEL_FIELDS)
    + " FROM bars JOIN v ON bars.symbol = v.symbol GROUP BY date",
)
R.add("src_05_close_panel", "symbol date close~", lambda t: I.close_panel(t.bars), "SELECT symbol, date, close FROM bars QUALIFY count(close) OVER (PARTITION BY symbol) >= 30")
R.add("src_06_index_definitions", "index_name description symbol", lambda t: I.index_definitions(t.membership.groupBy("index_name", "universe").agg(F.collect_list(F.col("symbol").cast("string")).alias("c")).select(F.to_json(F.create_map("index_name", F.struct(F.col("universe").alias("description"), F.col("c").alias("constituents")))).alias("value"))), "SELECT index_name, universe AS description, CAST(symbol AS VARCHAR) AS symbol FROM membership")
R.add("src_07_macro_rows", "indicator period value~", lambda t: I.macro_rows(t.monthly.select("indicator", F.when(F.month("period") == 7, "bad").otherwise(F.date_format("period", "yyyy-MM")).alias("Period"), F.when(F.month("period") == 8, "n/a").otherwise(F.format_string("%.2f", "value")).alias("Value"))), "SELECT indicator, period, round(value, 2) AS value FROM monthly WHERE month(period) NOT IN (7, 8)")
for how, agg in (("sum", "sum(v)"), ("mean", "avg(v)"), ("last", "arg_max(v, o_orderkey)")):
    R.add(f"src_08_records_to_series_{how}", "period value~", lambda t, how=how: I.records_to_series(t.table("orders").withColumn("seq", F.col("o_orderkey")), {"o_orderstatus": "O"}, X.period(F.date_format("o_orderdate", "yyyy-MM")), X.amount(F.format_string("%,.2f", "o_totalprice")), 0.001, how), f"SELECT strftime(o_orderdate, '%Y-%m') AS period, {agg} AS value FROM (SELECT *, round(o_totalprice, 2)*0.001 AS v FROM orders WHERE o_orderstatus = 'O') GROUP BY 1")
HELD = lambda t: t.positions.join(t.last_close, "symbol")
ONE = lambda t: I.broker_one(HELD(t).groupBy("symbol").agg(F.sum("quantity").alias("q"), F.first("last_close").alias("p")).select(F.format_string("IN%05d", "symbol").alias("ISIN"), F.concat(F.lit("S"), "symbol", F.when(F.col("symbol") % 2 == 0, "-BE").otherwise("")).alias("Symbol"), F.format_string("%,d", "q").alias("Qty"), F.format_string("%,.2f", F.col("symbol") * 1.0).alias("Avg Price"), F.format_string("%.4f", "p").alias("LTP")))
MASTER = lambda t: t.table("supplier").select(F.format_string("IN%05d", "s_suppkey").alias("isin"), F.concat(F.lit("M"), F.col("s_suppkey")).alias("symbol"), F.lit("EQ").alias("series"))
TWO = lambda t: I.broker_two(HELD(t).where("symbol % 3 = 0").groupBy("symbol").agg(F.sum("quantity").alias("q"), F.first("last_close").alias("p")).select(F.format_string("IN%05d", "symbol").alias("ISIN"), F.lit(" Name ").alias("Stock Name"), F.col("q").cast("string").alias("Quantity"), F.lit("10.5").alias("Average buy price"), F.format_string("%.2f", F.col("symbol") * 1000.0).alias("Closing value")), MASTER(t))
HELD_SQL = "SELECT symbol, sum(quantity) AS q FROM positions GROUP BY 1"
R.add("src_09_broker_one", "isin symbol series quantity# invested~", ONE, f"SELECT printf('IN%05d', symbol) AS isin, 'S' || symbol AS symbol, CASE WHEN symbol % 2 = 0 THEN 'BE' ELSE 'EQ' END AS series, q AS quantity, q*symbol AS invested FROM ({HELD_SQL})")
R.add("src_10_broker_two", "isin symbol company quantity# invested~ pnl~", TWO, f"SELECT printf('IN%05d', symbol) AS isin, 'M' || symbol AS symbol, 'Name' AS company, q AS quantity, q*10.5 AS invested, symbol*1000.0 - q*10.5 AS pnl FROM ({HELD_SQL}) WHERE symbol % 3 = 0")
R.add("src_11_unified_holdings", "isin source quantity#", lambda t: I.unified_holdings(ONE(t).where("cast(substr(isin, 3) as int) % 5 <> 0"), TWO(t)), f"SELECT printf('IN%05d', symbol) AS isin, CASE WHEN symbol % 5 <> 0 THEN 'one' ELSE 'two' END AS source, q AS quantity FROM ({HELD_SQL}) WHERE symbol % 5 <> 0 OR symbol % 3 = 0")
R.add("src_12_security_master", "isin symbol series", lambda t: I.security_master(MASTER(t).where("cast(substr(isin, 3) as int) % 2 = 0"), MASTER(t).withColumn("series", F.lit("SM"))), "SELECT printf('IN%05d', s_suppkey) AS isin, 'M' || s_suppkey AS symbol, CASE WHEN s_suppkey % 2 = 0 THEN 'EQ' ELSE 'SM' END AS series FROM supplier")
R.add("src_13_option_file", "underlying expiry strike~ type oi~", lambda t: I.option_rows(t.chain.select(F.concat(F.lit(" "), "underlying", F.lit(" ")).alias("TckrSymb"), F.date_format("expiry", "dd-MMM-yyyy").alias("XpryDt"), F.col("strike").cast("string").alias("StrkPric"), F.col("type").alias("OptnTp"), F.col("oi").cast("string").alias("OpnIntrst"), F.lit("4").alias("NewBrdLotQty"), F.col("und_price").cast("string").alias("UndrlygPric"), F.lit("STO").alias("FinInstrmTp"))), "SELECT underlying, expiry, strike, type, round_even(oi/4, 0) AS oi FROM chain")
R.add("src_14_deals_rename", "date code client side price~", lambda t: I.renamed_deals(t.deals.select(F.col("date").alias(" Deal Date"), F.col("code").alias("Scrip Code "), F.col("client").alias("Client Name"), F.col("side").alias("Deal Type"), F.col("price").alias("Price"), F.lit(1).alias("_id"))), "SELECT date, code, client, side, price FROM deals")
R.add("src_15_pipe_lines", "code client side", lambda t: I.pipe_lines(t.deals.select(F.when(F.col("code") % 7 == 0, F.concat_ws("|", F.col("code").cast("string"), "client")).otherwise(F.concat_ws(" | ", F.col("code").cast("string"), "client", "side")).alias("value")), ["code", "client", "side"]), "SELECT CAST(code AS VARCHAR) AS code, client, side FROM deals WHERE code % 7 <> 0")
R.add("src_17_screener_json", "event_id ticker pledge~ promoter~", lambda t: I.screener_rows(t.table("events").select("event_id", F.to_json(F.struct(F.struct(F.struct(F.col("user_id").cast("string").alias("ticker"), F.col("event_type").alias("name")).alias("info"), F.struct(F.col("value").alias("pledge"), F.get_json_object("props", "$.k").cast("double").alias("promoter")).alias("advancedRatios")).alias("stock"))).alias("json"))), "SELECT event_id, CAST(user_id AS VARCHAR) AS ticker, value AS pledge, CAST(json_extract(props, '$.k') AS DOUBLE) AS promoter FROM events")
YEARS = range(1992, 2003)  # all years of the tables
STATEMENT = lambda t: (lambda f: f.select("symbol", F.explode(F.array(*[F.struct(F.lit(label).alias("label"), F.col(c).alias("v")) for label, c in (("Sales", "revenue"), ("Expenses", "cogs"), ("Net Profit", "net_income"), ("Profit before tax", "pretax_income"), ("Equity Capital", "cash"), ("Reserves", "equity"))])).alias("s"), F.col("fy")).groupBy("symbol", F.col("s.label").alias("label")).pivot("fy", list(YEARS)).agg(F.first("s.v")).withColumn("TTM", F.lit(1.0)))(t.fundamentals)
ITEM_SQL = ", ".join(f"('{i}')" for i in ("revenue", "cogs", "net_income", "pretax_income", "share_capital", "reserves", "equity", "tax", "gross_profit"))
R.add("src_18_statement_rows", "symbol period item value~", lambda t: I.statement_rows(STATEMENT(t), [*map(str, YEARS), "TTM"], 1.0), f"SELECT * FROM (SELECT symbol, CAST(fy AS VARCHAR) AS period, item, CASE item WHEN 'revenue' THEN revenue WHEN 'cogs' THEN cogs WHEN 'net_income' THEN net_income WHEN 'pretax_income' THEN pretax_income WHEN 'share_capital' THEN cash WHEN 'reserves' THEN equity WHEN 'equity' THEN cash + equity WHEN 'tax' THEN pretax_income - net_income ELSE revenue - cogs END AS value FROM fundamentals CROSS JOIN (VALUES {ITEM_SQL}) i(item))")
CELLS = lambda t: t.fundamentals.select("symbol", F.col("fy").alias("period"), F.lit("revenue").alias("item"), (F.col("revenue") / 1000).alias("value"))
R.add("src_20_merged_statements", "symbol period item value~", lambda t: I.merged_statements(CELLS(t).where("period % 2 = 0 and symbol % 3 > 0"), CELLS(t).withColumn("value", F.col("value") + 1).where("period <> 1998")), "SELECT symbol, fy AS period, 'revenue' AS item, CASE WHEN fy % 2 = 0 AND symbol % 3 > 0 THEN revenue/1000 ELSE revenue/1000 + 1 END AS value FROM fundamentals WHERE (fy % 2 = 0 AND symbol % 3 > 0) OR fy <> 1998")
PAREN = lambda c: F.when(F.col(c) < 0, F.concat(F.lit("("), F.format_string("%,.2f", -F.col(c)), F.lit(")"))).otherwise(F.format_string("%,.2f", c))
R.add("src_21_flow_rows", "date buy~ sell~ net~", lambda t: I.flow_rows(t.flows.select(F.when(F.col("sector") == "BUILDING", "Total").otherwise(F.date_format("date", "dd-MMM-yyyy")).alias("day"), F.when(F.col("sector") == "MACHINERY", "Debt").otherwise("Equity").alias("category"), F.lit("Stock Exchange").alias("route"), *[PAREN(c).alias(c) for c in ("buy", "sell", "net")])), "SELECT date, round(buy, 2) AS buy, round(sell, 2) AS sell, round(net, 2) AS net FROM flows WHERE sector NOT IN ('BUILDING', 'MACHINERY')")
HEADERS = lambda t: t.table("orders").select(F.col("o_orderkey").alias("table_id"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("idx")).select("table_id", "idx", F.explode(F.array(F.struct(F.lit(0).alias("level"), F.when(F.col("idx") % 2 == 0, "Net Investment").otherwise("Gross").alias("text")), F.struct(F.lit(1).alias("level"), F.when((F.col("idx") + F.col("table_id")) % 3 == 0, "Equity").otherwise("Debt").alias("text")))).alias("h")).select("table_id", "idx", "h.*")
R.add("src_22_rightmost_header", "table_id idx#", lambda t: I.rightmost_column(HEADERS(t), ("net", "investment", "equity")), "SELECT o_orderkey AS table_id, max(i) AS idx FROM orders CROSS JOIN (SELECT unnest(range(6)) AS i) WHERE i % 2 = 0 AND (i + o_orderkey) % 3 = 0 GROUP BY 1")
R.add("src_23_sector_report", "sector net~ period report_date", lambda t: I.sector_report(t.flows.select(F.when(F.dayofmonth("date") == 1, "Grand Total").when(F.dayofmonth("date") == 2, " ").otherwise(F.col("sector")).alias("sector"), PAREN("net").alias("net"), F.date_format("date", "yyyy-MM").alias("period"), F.col("date").alias("report_date"))), "SELECT sector, round(net, 2) AS net, strftime(date, '%Y-%m') AS period, date AS report_date FROM flows WHERE day(date) > 2")
R.add("src_24_offerings", "symbol listing series", lambda t: I.offerings(t.deals.select(F.when(F.col("code") % 4 == 0, F.concat(F.lit("9"), "client")).otherwise(F.col("client")).alias("symbol"), F.col("date").alias("listing"), F.when(F.col("code") % 3 == 0, "EQ").when(F.col("code") % 3 == 1, "SME").otherwise("BE").alias("series")), F.lit("1998-01-01").cast("date"), F.lit("1998-06-30").cast("date")), "SELECT client AS symbol, date AS listing, CASE code % 3 WHEN 0 THEN 'EQ' ELSE 'SME' END AS series FROM deals WHERE date BETWEEN DATE '1998-01-01' AND DATE '1998-06-30' AND code % 3 < 2 AND code % 4 <> 0")
R.add("src_25_week_names", "name week# day month", lambda t: I.weeks(t.table("orders").select(F.to_date("o_orderdate").alias("d")).distinct().select(F.when(F.dayofweek("d") == 1, "junk").otherwise(F.concat(F.lit("Week"), F.weekofyear("d"), F.lit("-"), F.date_format("d", "dd"), F.date_format("d", "MMM"))).alias("name")).distinct()), "SELECT DISTINCT 'Week' || weekofyear(d) || '-' || strftime(d, '%d%b') AS name, weekofyear(d) AS week, strftime(d, '%d') AS day, strftime(d, '%b') AS month FROM (SELECT DISTINCT CAST(o_orderdate AS date) AS d FROM orders) WHERE dayofweek(d) <> 0")


def report_sink(t):
    """Write monthly totals twice, one month anew: the partition is replaced, the others stay."""
    path = f"{shared_folder(t.spark)}/report-{uuid.uuid4().hex}"
    first = t.monthly.groupBy("period").agg(F.count("*").alias("n"))
    I.write_report(first, path, "period")
    I.write_report(first.where("period = date'1996-01-01'").withColumn("n", F.col("n") + 100), path, "period")
    return t.spark.read.parquet(path).select(F.col("period").cast("date").alias("period"), "n")


R.add("src_26_report_sink", "period n#", report_sink, "SELECT period, count(*) + CASE WHEN period = DATE '1996-01-01' THEN 100 ELSE 0 END AS n FROM monthly GROUP BY 1")
R.add("src_28_universe_union", "symbol universe", lambda t: t.membership.where("universe in ('ASIA', 'EUROPE')").select("symbol", "universe").unionByName(t.table("supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("symbol"), F.lit("SME").alias("universe"))), "SELECT symbol, universe FROM membership WHERE universe IN ('ASIA', 'EUROPE') UNION ALL SELECT s_suppkey, 'SME' FROM supplier WHERE s_acctbal > 5000")
R.add("src_29_option_underlyings", "underlying", lambda t: t.chain.where("type = 'CE'").select("underlying").distinct().orderBy("underlying"), "SELECT DISTINCT underlying FROM chain WHERE type = 'CE'")
R.add("src_31_newest_shareholdings", "ticker as_of pct~", lambda t: I.newest_n(t.stakes, "ticker", "as_of", 12), "SELECT * FROM stakes QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY as_of DESC) <= 12")
# ---- joins
R.add("flt_18_owned_filter", "code client", lambda t: t.deals.join(t.table("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("client_id")), "client_id", "left_semi"), "SELECT code, client FROM deals WHERE client_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
R.add("jn_04_exact_client_membership", "code client", lambda t: t.deals.join(t.table("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_name").alias("client")), "client", "left_semi"), "SELECT code, client FROM deals WHERE client IN (SELECT c_name FROM customer WHERE c_mktsegment = 'BUILDING')")
R.add("jn_05_without_underlyings", "symbol", lambda t: t.membership.join(t.table("supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("symbol")), "symbol", "left_anti"), "SELECT symbol FROM membership WHERE symbol NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")
WATCH = lambda t: t.table("part").select(F.element_at(F.split("p_name", " "), 1).alias("name")).distinct()
NORM = "trim(regexp_replace(upper({}), '[^A-Z0-9]+', ' ', 'g'))"
R.add("jn_07_watch_list", "id matches", lambda t: J.watch_matches(t.table("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), WATCH(t)), f"WITH w AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS w FROM part) SELECT p_partkey AS id, string_agg(w, ',' ORDER BY w) AS matches FROM part JOIN w ON contains({NORM.format('p_name')}, {NORM.format('w')}) OR contains({NORM.format('w')}, {NORM.format('p_name')}) GROUP BY 1")
EVENTS = lambda t: t.deals.select(F.element_at(F.array(*map(F.lit, J.EVENT_WINDOWS)), (F.col("code") % 3 + 1).cast("int")).alias("kind"), F.col("client_id").alias("symbol"), "date", "code")
R.add(
    "jn_13_event_window",
    "as_of kind symbol code date",
    lambda t: J.event_windows(EVENTS(t), t.table("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("symbol")), t.deals.select(F.trunc("date", "quarter").alias("as_of")).distinct()),
    """WITH e AS (SELECT ['board meeting', 'corporate action', 'announcement'][o_orderkey % 3 + 1] AS kind, o_custkey AS symbol, CAST(o_orderdate AS date) AS date, o_orderkey AS code FROM orders),
    d AS (SELECT DISTINCT CAST(date_trunc('quarter', date) AS date) AS as_of FROM e)
    SELECT as_of, kind, symbol, code, date FROM e JOIN d ON date BETWEEN CASE kind WHEN 'announcement' THEN as_of - INTERVAL 7 DAY ELSE as_of END AND CASE kind WHEN 'announcement' THEN as_of ELSE as_of + INTERVAL 30 DAY END
    WHERE symbol IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""",
)
R.add("jn_15_progressive_key", "id key", lambda t: J.progressive_key(t.table("part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" Holdings Pvt Ltd")).alias("name")), t.table("part").where("p_partkey % 3 = 0").select(X.slug("p_name").alias("key")).distinct()), """
WITH s AS (SELECT p_partkey AS id, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') || '-holdings-pvt' AS s FROM part), k AS (SELECT DISTINCT trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS key FROM part WHERE p_partkey % 3 = 0),
c AS (SELECT id, string_split(s, '-') AS p FROM s), e AS (SELECT id, len(p) - n AS rank, array_to_string(p[1:n], '-') AS key FROM c, (SELECT unnest(range(2, 12)) AS n) WHERE n <= len(p)),
l AS (SELECT id, 1000 AS rank, k.key FROM c JOIN k ON list_contains(list_transform(range(1, greatest(len(string_split(k.key, '-')) - 2, 1) + 1), lambda i: array_to_string(string_split(k.key, '-')[i:i+2], '-')), array_to_string(p[1:3], '-')))
SELECT id, key FROM (SELECT e.* FROM e JOIN k ON e.key = k.key UNION ALL SELECT * FROM l) QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank, key) = 1""")
R.add("jn_16_similar_keys", "id key similarity~ place#", lambda t: J.similar_keys(t.table("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), t.table("part").select(X.slug("p_name").alias("key")).distinct()), """
WITH s AS (SELECT p_partkey AS id, p_size, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM part), k AS (SELECT DISTINCT s AS key FROM s), x AS (SELECT id, key, 1 - levenshtein(s, key)/greatest(length(s), length(key))::DOUBLE AS similarity FROM s CROSS JOIN k)
SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, key) AS place FROM x WHERE similarity >= 0.7 QUALIFY place <= 5""")
R.add(
    "jn_16_close_matches",
    "id key similarity~ place#",
    lambda t: J.close_matches(t.table("part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, " Pvt Ltd").otherwise(" Ltd")).alias("name")), t.table("part").where("p_partkey % 3 = 0").select(F.concat(X.slug("p_name"), F.when(F.col("p_size") % 2 == 0, "-limited").otherwise("-india")).alias("key")).distinct()),
)
R.add("jn_17_listing_ladder", "ticker exchange token", lambda t: J.resolved(t.table("supplier").select(F.concat(F.lit("S"), F.col("s_suppkey"), F.when(F.col("s_suppkey") % 4 == 0, ".NS").when(F.col("s_suppkey") % 4 == 1, ".BO").otherwise("")).alias("ticker")), t.table("supplier").select(F.when(F.col("s_suppkey") % 3 == 0, "NSE").otherwise("BSE").alias("exchange"), F.concat(F.lit("S"), F.col("s_suppkey"), F.when(F.col("s_suppkey") % 2 == 0, "-EQ").when(F.col("s_suppkey") % 5 == 0, "-SM").otherwise("")).alias("name"), F.col("s_suppkey").cast("string").alias("token"))), "SELECT 'S' || s_suppkey || CASE s_suppkey % 4 WHEN 0 THEN '.NS' WHEN 1 THEN '.BO' ELSE '' END AS ticker, CASE WHEN s_suppkey % 3 = 0 THEN 'NSE' ELSE 'BSE' END AS exchange, CAST(s_suppkey AS VARCHAR) AS token FROM supplier WHERE (s_suppkey % 4 <> 0 OR s_suppkey % 3 = 0) AND (s_suppkey % 4 <> 1 OR s_suppkey % 3 <> 0)")
R.add("jn_18_alternate_listing", "symbol close~", lambda t: (lambda a, b: t.membership.select("symbol").join(a, "symbol", "left").join(b, "symbol", "left").select("symbol", F.coalesce("c1", "c2").alias("close")))(t.last_close.where("symbol % 2 = 0").withColumnRenamed("last_close", "c1"), t.last_close.where("symbol % 3 = 0").select("symbol", (F.col("last_close") + 1).alias("c2"))), "SELECT m.symbol, CASE WHEN m.symbol % 2 = 0 THEN last_close WHEN m.symbol % 3 = 0 THEN last_close + 1 END AS close FROM membership m LEFT JOIN last_closes l ON m.symbol = l.symbol")
# ---- merges
KEPT, NEW = (lambda t: t.monthly.where("month(period) <= 8")), (lambda t: t.monthly.where("month(period) >= 6").withColumn("value", F.col("value") + 1))
R.add("set_03_dedupe", "ticker as_of pct~", lambda t: M.dedupe(t.stakes, ["ticker"], F.desc("as_of")), "SELECT * FROM stakes QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY as_of DESC) = 1")


def merged(t, keys, kept, new, rule):
    """A stored table of kept rows after a batch of new ones has been merged into its buckets."""
    table = KeyedTable(t.spark, folder(t, "merged"), keys)
    for batch, rows in enumerate((kept, new)):
        table.merge(rows, rule, batch)
    return table.read()


KEYS = ["indicator", "period"]
UPSERT, INSERT = (lambda kept, new: M.upsert(kept, new, KEYS)), (lambda kept, new: M.insert_absent(kept, new, KEYS))
URGENT = "indicator = 'm_1-URGENT'"
ONE_VALUE = lambda t: t.monthly.where(f"{URGENT} and period = date'1996-01-01'").withColumn("value", F.lit(42.0))
R.add("set_04_upsert", "indicator period value$", lambda t: merged(t, KEYS, KEPT(t), NEW(t), UPSERT), "SELECT indicator, period, CASE WHEN month(period) >= 6 THEN value + 1 ELSE value END AS value FROM monthly")
R.add(
    "set_05_replace_by_date",
    "indicator period value$",
    lambda t: merged(t, ["period"], KEPT(t), NEW(t).where(URGENT), lambda kept, new: M.replace_dates(kept, new, "period")),
    """SELECT indicator, period, value FROM monthly WHERE month(period) <= 8 AND period NOT IN (SELECT period FROM monthly WHERE month(period) >= 6 AND indicator = 'm_1-URGENT')
    UNION ALL SELECT indicator, period, value + 1 FROM monthly WHERE month(period) >= 6 AND indicator = 'm_1-URGENT'""",
)
R.add("set_06_insert_absent", "indicator period value$", lambda t: merged(t, KEYS, KEPT(t), NEW(t), INSERT), "SELECT indicator, period, CASE WHEN month(period) > 8 THEN value + 1 ELSE value END AS value FROM monthly")
R.add("set_07_provisional_flows", "date sector net$", lambda t: M.official_over_provisional(t.flows.select("date", "sector", "net", F.lit(False).alias("official"), F.lit(1).alias("seq")).unionByName(t.flows.where("day(date) <= 15").select("date", "sector", (F.col("net") + 1).alias("net"), F.lit(True).alias("official"), F.lit(2).alias("seq"))), ["date", "sector"]), "SELECT date, sector, CASE WHEN day(date) <= 15 THEN net + 1 ELSE net END AS net FROM flows")
R.add(
    "set_08_store_one_value",
    "indicator period value$",
    lambda t: merged(t, KEYS, t.monthly, ONE_VALUE(t), UPSERT),
    "SELECT indicator, period, CASE WHEN indicator = 'm_1-URGENT' AND period = DATE '1996-01-01' THEN 42 ELSE value END AS value FROM monthly",
)


def appended(t):
    """Statistics appended run by run, one partition a review date; the same date again replaces its partition."""
    path = f"{shared_folder(t.spark)}/runs-{uuid.uuid4().hex}"
    stats = t.flows.groupBy(F.trunc("date", "month").alias("review_date")).agg(F.count("*").alias("n"), F.sum("net").alias("net"))
    for _ in range(2):
        I.write_report(stats, path, "review_date")
    return t.spark.read.parquet(path).select(F.col("review_date").cast("date").alias("review_date"), "n", "net")


R.add("set_09_run_statistics", "review_date n# net$", appended, "SELECT CAST(date_trunc('month', date) AS date) AS review_date, count(*) AS n, sum(net) AS net FROM flows GROUP BY 1")


# ---- streams, worked through to the end
def ticks(t):
    stream = _stream(t, "events", t.table("events").schema)
    return stream.select(F.col("user_id").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.lit(1.0).alias("size"), F.col("event_id").alias("seq"))


def _stream(t, name, schema):
    """A stream over one given table: the files of its folder, or of its parent with the table's name."""
    path = t.spark._jvm.org.apache.hadoop.fs.Path(f"{t.sf_dir}/{name}.parquet")
    if path.getFileSystem(t.spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return t.spark.readStream.schema(schema).parquet(path.toString())
    return t.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(t.sf_dir)


def folder(t, name):
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


def streamed_bars(t):
    out = folder(t, "bars-stream")
    _append(jobs.daily_bars(ticks(t), "0 seconds"), out)
    return t.spark.read.schema("symbol long, date date, open double, high double, low double, close double, volume double").parquet(out)


def _append(stream, out):
    q = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", out + "-state").trigger(availableNow=True).start()
    q.awaitTermination()


R.add("st_01_streamed_daily_bars", "symbol date open~ high~ low~ close~ volume~", streamed_bars, "WITH b AS (SELECT user_id AS symbol, CAST(ts AS date) AS date, arg_min(value, epoch_us(ts)) AS open, max(value) AS high, min(value) AS low, arg_max(value, epoch_us(ts)) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2) SELECT * FROM b WHERE date < (SELECT CAST(max(ts) AS date) FROM events)")


def streamed_late_ticks(t):
    """Events land in three parts, one after the other; rows of days that earlier parts have closed go to the side table."""
    landed, out = folder(t, "landed"), folder(t, "late-ticks")
    events = t.table("events")
    for part in range(3):
        events.where(F.col("event_id") % 3 == part).write.mode("append").parquet(landed)
        stream = t.spark.readStream.schema(events.schema).parquet(landed).select(F.col("user_id").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))
        jobs.run_once(stream, out + "-state", jobs.keep_late(out, "2 days"))
    return t.spark.read.parquet(f"{out}/late").groupBy("symbol").agg(F.count("*").alias("n"), F.min("seq").alias("first"))


R.add(
    "st_01_late_ticks",
    "symbol n# first#",
    streamed_late_ticks,
    """WITH m AS (SELECT event_id % 3 AS part, max(ts) AS newest FROM events GROUP BY 1)
    SELECT user_id AS symbol, count(*) AS n, min(event_id) AS first FROM events e WHERE date_trunc('day', ts) + INTERVAL 3 DAY <= (SELECT max(newest) FROM m WHERE m.part < e.event_id % 3) GROUP BY 1""",
)


def streamed_upsert(t):
    out = folder(t, "history")
    stream = _stream(t, "orders", t.table("orders").schema).select(F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("seq"))
    jobs.run_once(stream, out + "-state", jobs.merging(out, ["key"]))
    return KeyedTable(t.spark, out, ["key"]).read()


R.add("st_02_streamed_upsert", "key value~ seq#", streamed_upsert, "SELECT o_custkey AS key, o_totalprice AS value, o_orderkey AS seq FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")


def streamed_alerts(t):
    out = folder(t, "alerts")
    levels = t.table("events").groupBy(F.col("user_id").alias("symbol")).agg(F.avg("value").alias("m")).select("symbol", (F.col("m") * 0.2).alias("stop"), (F.col("m") * 4).alias("target"))
    _append(jobs.level_alerts(ticks(t), levels), out)
    return t.spark.read.schema("symbol long, ts timestamp, price double, status string").parquet(out).groupBy("symbol", "status").agg(F.count("*").alias("n"), F.min_by("price", F.struct("ts", "price")).alias("first_price"))


R.add(
    "st_03_level_alerts",
    "symbol status n# first_price~",
    streamed_alerts,
    """WITH l AS (SELECT user_id AS symbol, avg(value)*0.2 AS stop, avg(value)*4 AS target FROM events GROUP BY 1),
    s AS (SELECT symbol, ts, event_id, value, CASE WHEN value <= stop THEN 'STOP_HIT' WHEN value >= target THEN 'TARGET_HIT' ELSE 'NONE' END AS status FROM events JOIN l ON user_id = symbol),
    c AS (SELECT *, lag(status, 1, 'NONE') OVER (PARTITION BY symbol ORDER BY ts, event_id) AS before FROM s)
    SELECT symbol, status, count(*) AS n, arg_min(value, (ts, value)) AS first_price FROM c WHERE status <> 'NONE' AND status <> before GROUP BY 1, 2""",
)


def streamed_breadth(t):
    out = folder(t, "breadth")
    stream = _stream(t, "lineitem", t.table("lineitem").schema).select(F.to_date("l_shipdate").alias("date"), F.col("l_suppkey").alias("symbol"), "l_quantity")

    def each(batch, batch_id):
        jobs.merging(out, ["date"], "replace")(batch.groupBy("date").agg(F.count_distinct("symbol").alias("symbols"), F.sum("l_quantity").alias("volume")), batch_id)

    jobs.run_once(stream, out + "-state", each)
    return KeyedTable(t.spark, out, ["date"]).read()


R.add("st_04_streamed_breadth", "date symbols# volume~", streamed_breadth, "SELECT CAST(l_shipdate AS date) AS date, count(DISTINCT l_suppkey) AS symbols, sum(l_quantity) AS volume FROM lineitem GROUP BY 1")
R.add(
    "ud_03_similarity_by_blocks",
    "id n#",
    lambda t: J.similar_keys(t.table("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), t.table("part").select(X.slug("p_name").alias("key")).distinct(), least=0.9).groupBy("id").agg(F.count("*").alias("n")),
    """WITH s AS (SELECT p_partkey AS id, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM part), k AS (SELECT DISTINCT s AS key FROM s)
    SELECT id, least(count(*), 5) AS n FROM s CROSS JOIN k WHERE 1 - levenshtein(s, key)/greatest(length(s), length(key))::DOUBLE >= 0.9 GROUP BY 1""",
)
QUERIES, ORACLE = R.queries, R.oracle
