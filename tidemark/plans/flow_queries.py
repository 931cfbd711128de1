"""Queries over flows, stakes, option chains and macro series."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from ..operators import flows as O
from ..operators import merge as M
from .registry import Registry

R = Registry()


def by_sector():
    return Window.partitionBy("sector").orderBy("date")


def as_of_day():
    return F.lit("2001-06-30").cast("date")

R.add("agg_06_net_by_sector", "sector net$ days#", lambda t: t.flows.groupBy("sector").agg(F.sum("net").alias("net"), F.count("*").alias("days")), "SELECT sector, sum(net) AS net, count(*) AS days FROM flows GROUP BY 1")
R.add("top_02_top_and_bottom_sectors", "side sector net$", lambda t: (lambda s: s.orderBy(F.desc("net")).limit(2).withColumn("side", F.lit("top")).unionByName(s.orderBy("net").limit(2).withColumn("side", F.lit("bottom"))))(t.flows.groupBy("sector").agg(F.sum("net").alias("net"))),
      "WITH s AS (SELECT sector, sum(net) AS net FROM flows GROUP BY 1) SELECT 'top' AS side, * FROM (SELECT * FROM s ORDER BY net DESC LIMIT 2) UNION ALL SELECT 'bottom', * FROM (SELECT * FROM s ORDER BY net LIMIT 2)")
R.add("agg_07_open_interest_by_date", "expiry oi~", lambda t: t.chain.where(F.col("underlying").isin("Brand#11", "Brand#22", "Brand#33", "Brand#44")).groupBy("expiry").agg(F.sum("oi").alias("oi")), "SELECT expiry, sum(oi) AS oi FROM chain WHERE underlying IN ('Brand#11', 'Brand#22', 'Brand#33', 'Brand#44') GROUP BY 1")
OI_SQL = """SELECT underlying, expiry, arg_max(strike, oi*1000 - strike) FILTER (type = 'CE') AS ce_strike, arg_max(strike, oi*1000 - strike) FILTER (type = 'PE') AS pe_strike, sum(oi) FILTER (type = 'CE') AS ce_oi, sum(oi) FILTER (type = 'PE') AS pe_oi,
 sum(oi) FILTER (type = 'PE')/sum(oi) FILTER (type = 'CE') AS pcr, max(und_price) AS und_price FROM {} GROUP BY 1, 2"""
OI_SPEC = "underlying expiry ce_strike pe_strike ce_oi~ pe_oi~ pcr~ und_price~"
R.add("agg_08_chain_nearest_expiry", OI_SPEC, lambda t: O.max_open_interest(O.nearest_expiry(t.chain)), OI_SQL.format("(SELECT * FROM chain QUALIFY expiry = min(expiry) OVER (PARTITION BY underlying))"))
R.add("agg_09_monthly_expiry", OI_SPEC, lambda t: O.max_open_interest(O.monthly_expiries(t.chain)), OI_SQL.format("(SELECT * FROM chain QUALIFY expiry = max(expiry) OVER (PARTITION BY underlying, date_trunc('month', expiry)))"))
R.add("agg_18_fund_crowding", "symbol n# avg_weight~ max_weight~ score~", lambda t: (lambda p: p.groupBy("symbol", "parent").agg(F.max("w").alias("w")).groupBy("symbol").agg(F.count("*").alias("n"), F.avg("w").alias("avg_weight"), F.max("w").alias("max_weight"), (F.count("*") * F.avg("w")).alias("score")))(t.holdings.withColumn("w", ratio("present", F.sum("present").over(Window.partitionBy("portfolio")))).withColumn("parent", F.floor(F.col("portfolio") / 10))), """
WITH w AS (SELECT symbol, portfolio // 10 AS parent, present/sum(present) OVER (PARTITION BY portfolio) AS w FROM holdings), p AS (SELECT symbol, parent, max(w) AS w FROM w GROUP BY 1, 2) SELECT symbol, count(*) AS n, avg(w) AS avg_weight, max(w) AS max_weight, count(*)*avg(w) AS score FROM p GROUP BY 1""")
R.add("agg_20_indicator_overview", "indicator n# latest value$", lambda t: t.monthly.groupBy("indicator").agg(F.count("*").alias("n"), F.max("period").alias("latest"), F.max_by("value", "period").alias("value")), "SELECT indicator, count(*) AS n, max(period) AS latest, arg_max(value, period) AS value FROM monthly GROUP BY 1")
R.add("agg_21_flow_summary", "sector latest$ cumulative$ high$ low$ mean~", lambda t: t.flows.groupBy("sector").agg(F.max_by("net", "date").alias("latest"), F.sum("net").alias("cumulative"), F.max("net").alias("high"), F.min("net").alias("low"), F.avg("net").alias("mean")), "SELECT sector, arg_max(net, date) AS latest, sum(net) AS cumulative, max(net) AS high, min(net) AS low, avg(net) AS mean FROM flows GROUP BY 1")
HOLDERS = lambda t: t.holdings.select("symbol", F.col("portfolio").alias("holder"), F.when(F.col("portfolio") % 3 == 0, "fund").otherwise("institution").alias("kind"), (F.col("quantity") / 1000).alias("pct"))
R.add(
    "agg_23_institutional_top_holders",
    "symbol kind total_pct~ holders# holder pct~ rank#",
    lambda t: O.institutional_holders(HOLDERS(t)),
    """WITH h AS (SELECT symbol, portfolio AS holder, CASE WHEN portfolio % 3 = 0 THEN 'fund' ELSE 'institution' END AS kind, quantity/1000.0 AS pct FROM holdings)
    SELECT symbol, kind, sum(pct) OVER w AS total_pct, count(*) OVER w AS holders, holder, pct, row_number() OVER (PARTITION BY symbol, kind ORDER BY pct DESC, holder) AS rank FROM h WINDOW w AS (PARTITION BY symbol, kind) QUALIFY rank <= 5""",
)
R.add(
    "agg_24_dividend_history",
    "symbol payments# years# total~ mean~ growth~",
    lambda t: O.dividend_history(t.deals.where("side = 'S'").select(F.col("client_id").alias("symbol"), "date", F.col("code").alias("seq"), F.col("price").alias("amount"))),
    """WITH d AS (SELECT client_id AS symbol, list(price ORDER BY date DESC, code DESC) AS a, count(DISTINCT year(date)) AS years FROM deals WHERE side = 'S' GROUP BY 1)
    SELECT symbol, len(a) AS payments, years, list_sum(a) AS total, list_avg(a) AS mean, CASE WHEN len(a) >= 4 AND list_sum(a[-2:]) > 0 THEN (list_sum(a[1:2]) / list_sum(a[-2:]) - 1) * 100 ELSE 0 END AS growth FROM d""",
)
R.add(
    "agg_30_shareholding_trend",
    "ticker quarters# promoter~ public~ promoter_1y~ promoter_qoq~ public_1y~ trend",
    lambda t: O.shareholding_trend(t.stakes.select("ticker", "as_of", F.col("pct").alias("promoter_pct"), F.greatest(F.lit(0.0), 55 - F.col("pct") * 1.5).alias("public_pct"))),
    """WITH l AS (SELECT ticker, list(pct ORDER BY as_of DESC) AS p, list(greatest(0, 55 - pct * 1.5) ORDER BY as_of DESC) AS u FROM stakes GROUP BY 1 HAVING count(*) >= 2), m AS (SELECT *, p[1:8] AS e, len(p) AS quarters FROM l)
    SELECT ticker, quarters, p[1] AS promoter, u[1] AS public, p[1] - p[least(5, quarters)] AS promoter_1y, p[1] - p[2] AS promoter_qoq, u[1] - u[least(5, quarters)] AS public_1y,
      CASE WHEN quarters < 4 THEN 'stable' WHEN list_avg(e[1:2]) > list_avg(e[-2:]) + 1.5 THEN 'increasing' WHEN list_avg(e[1:2]) < list_avg(e[-2:]) - 1.5 THEN 'decreasing' ELSE 'stable' END AS trend FROM m""",
)
R.add("agg_32_monthly_net_by_group", "period equity$ debt$", lambda t: t.monthly.groupBy("period").agg(F.sum(F.when(F.col("indicator") == "m_1-URGENT", F.col("value"))).alias("equity"), F.sum(F.when(F.col("indicator").like("m_2%") | F.col("indicator").like("m_3%"), F.col("value"))).alias("debt")), "SELECT period, sum(value) FILTER (indicator = 'm_1-URGENT') AS equity, sum(value) FILTER (indicator LIKE 'm_2%' OR indicator LIKE 'm_3%') AS debt FROM monthly GROUP BY 1")
R.add("win_24_cumulative_flow", "sector date running$ change$", lambda t: t.flows.withColumn("running", F.sum("net").over(by_sector().rowsBetween(Window.unboundedPreceding, 0))).withColumn("change", F.col("net") - F.lag("net").over(by_sector())), "SELECT sector, date, sum(net) OVER (PARTITION BY sector ORDER BY date ROWS UNBOUNDED PRECEDING) AS running, net - lag(net) OVER (PARTITION BY sector ORDER BY date) AS change FROM flows")
R.add("win_25_cumulative_flow_on_grid", "sector date net$ running$", lambda t: t.flows.select("sector").distinct().crossJoin(F.broadcast(t.flows.agg(F.collect_set("date").alias("dates")))).select("sector", F.explode("dates").alias("date")).join(t.flows.select("sector", "date", "net"), ["sector", "date"], "left").withColumn("net", F.coalesce("net", F.lit(0.0))).withColumn("running", F.sum("net").over(by_sector().rowsBetween(Window.unboundedPreceding, 0))), """
WITH g AS (SELECT s.sector, d.date, coalesce(f.net, 0) AS net FROM (SELECT DISTINCT sector FROM flows) s CROSS JOIN (SELECT DISTINCT date FROM flows) d LEFT JOIN flows f ON f.sector = s.sector AND f.date = d.date) SELECT *, sum(net) OVER (PARTITION BY sector ORDER BY date ROWS UNBOUNDED PRECEDING) AS running FROM g""")
R.add("win_26_row_offset_growth", "indicator period mom~ qoq~ yoy~", lambda t: O.row_growth(t.monthly), "SELECT indicator, period, (value/lag(value) OVER w - 1)*100 AS mom, (value/lag(value,3) OVER w - 1)*100 AS qoq, (value/lag(value,12) OVER w - 1)*100 AS yoy FROM monthly WINDOW w AS (PARTITION BY indicator ORDER BY period)")
STREAK_SQL = """s AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY as_of DESC) AS age, coalesce(lag(pct) OVER w < pct AND lag(as_of) OVER w = CAST(last_day(as_of - INTERVAL 3 MONTH) AS date), false) AS rose FROM stakes WHERE as_of <= DATE '2001-06-30' WINDOW w AS (PARTITION BY ticker ORDER BY as_of)),
k AS (SELECT ticker, coalesce(min(age) FILTER (NOT rose) - 1, count(*)) AS streak FROM s GROUP BY 1 HAVING max(as_of) = DATE '2001-06-30')"""
R.add("win_27_rise_streak", "ticker streak#", lambda t: O.streaks(t.stakes, as_of_day()), f"WITH {STREAK_SQL} SELECT * FROM k")
R.add("win_28_quarter_arithmetic", "date this_quarter latest_complete", lambda t: t.table("orders").select(F.to_date("o_orderdate").alias("date")).distinct().select("date", F.last_day(F.add_months(F.trunc("date", "quarter"), 2)).alias("this_quarter"), O.shift_quarter(F.last_day(F.add_months(F.trunc("date", "quarter"), 2)), -1).alias("latest_complete")), """
SELECT DISTINCT CAST(o_orderdate AS date) AS date, CAST(last_day(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH) AS date) AS this_quarter, CAST(last_day(date_trunc('quarter', o_orderdate) - INTERVAL 1 MONTH) AS date) AS latest_complete FROM orders""")
CHG = lambda n: f"LEFT JOIN stakes s{n} ON s{n}.ticker = s.ticker AND s{n}.as_of = CAST(last_day(s.as_of - INTERVAL {3 * n} MONTH) AS date)"
CHG_SQL = "SELECT s.ticker, s.as_of, s.pct, " + ", ".join(f"s.pct - s{n}.pct AS chg_{3 * n}m" for n in (1, 2, 3, 4)) + " FROM stakes s " + " ".join(CHG(n) for n in (1, 2, 3, 4))
R.add("win_30_stake_changes", "ticker as_of pct~ chg_3m~ chg_6m~ chg_9m~ chg_12m~", lambda t: O.stake_changes(t.stakes), CHG_SQL)
R.add("win_29_snapshot_backfill", "ticker as_of pct~", lambda t: O.backfilled(O.stake_changes(t.stakes).where(F.col("as_of") == as_of_day()), as_of_day()), f"WITH c AS (SELECT * FROM ({CHG_SQL}) WHERE as_of = DATE '2001-06-30') " + " UNION ALL ".join(["SELECT ticker, as_of, pct FROM c"] + [f"SELECT ticker, CAST(last_day(as_of - INTERVAL {3 * n} MONTH) AS date) AS as_of, greatest(0, pct - chg_{3 * n}m) AS pct FROM c WHERE chg_{3 * n}m IS NOT NULL" for n in (1, 2, 3, 4)]))


def classified(t):
    now = O.stake_changes(t.stakes).where(F.col("as_of") == as_of_day()).join(O.streaks(t.stakes, as_of_day()), "ticker")
    x = now.withColumn("category", O.stake_category(F.col("pct"), F.col("chg_3m"), F.col("streak")))
    return x.withColumn("slice", O.stake_slice(F.col("category"), F.col("streak"), F.col("pct")))


CLASS_SQL = f"""WITH {STREAK_SQL}, c AS (SELECT c.*, streak, CASE WHEN pct - coalesce(chg_3m, 0) < 0.05 THEN 'New Entry' WHEN streak >= 4 THEN '4-Quarter Increasing' WHEN streak = 3 THEN '3-Quarter Increasing' WHEN streak = 2 THEN 'Multi-Quarter Increasing' ELSE 'Increased Stake' END AS category FROM ({CHG_SQL}) c JOIN k ON c.ticker = k.ticker WHERE as_of = DATE '2001-06-30')
SELECT *, CASE WHEN category = 'New Entry' AND pct > 1 THEN 'FII_New_Entry' WHEN category = 'New Entry' THEN NULL WHEN streak >= 4 THEN 'FII_4Q_Increasing' WHEN streak = 3 THEN 'FII_3Q_Increasing' WHEN streak = 2 THEN 'FII_2Q_Increasing' ELSE 'FII_1Q_Increasing' END AS slice FROM c"""
R.add("flt_14_stake_category", "ticker pct~ streak# category", classified, CLASS_SQL)
R.add("flt_15_stake_slices", "slice ticker pct~", lambda t: classified(t).where("slice is not null"), f"SELECT * FROM ({CLASS_SQL}) WHERE slice IS NOT NULL")
R.add("top_08_category_then_change", "ticker category chg_3m~ place#", lambda t: M.numbered(classified(t), "place", F.asc("category"), F.desc_nulls_last("chg_3m"), F.asc("ticker")), f"SELECT *, row_number() OVER (ORDER BY category, chg_3m DESC NULLS LAST, ticker) AS place FROM ({CLASS_SQL})")
R.add("flt_16_investor_change", "ticker as_of flag change~", lambda t: O.investor_change(t.stakes), "SELECT *, pct - coalesce(before, 0) AS change FROM (SELECT *, CASE WHEN before IS NULL OR before = 0 THEN 'New Entry' WHEN pct > before THEN 'Increased' END AS flag FROM (SELECT *, lag(pct) OVER (PARTITION BY ticker ORDER BY as_of) AS before FROM stakes) WHERE pct <> 0) WHERE flag IS NOT NULL")


def near_sql(low, high, order):
    return f"SELECT s.ticker, s.as_of, s.pct, (SELECT arg_min(o.pct, {order}) FROM stakes o WHERE o.ticker = s.ticker AND date_diff('day', o.as_of, s.as_of) BETWEEN {low} AND {high}) AS before FROM stakes s"


DAYS = "date_diff('day', o.as_of, s.as_of)"
R.add("jn_08_nearest_snapshot", "ticker as_of pct~ before~", lambda t: O.near_before(t.stakes, "ticker", "as_of", "pct", 60, 120, 90), near_sql(60, 120, f"abs({DAYS} - 90)*1000 + {DAYS}"))
R.add("jn_09_fun_35_order_book_changes", "ticker as_of qoq~ yoy~", lambda t: O.near_before(O.near_before(t.stakes, "ticker", "as_of", "pct", 60, 150).withColumnRenamed("before", "q"), "ticker", "as_of", "pct", 300, 450).select("ticker", "as_of", ((ratio("pct", "q") - 1) * 100).alias("qoq"), ((ratio("pct", "before") - 1) * 100).alias("yoy")),
      f"SELECT q.ticker, q.as_of, (q.pct/nullif(q.before, 0) - 1)*100 AS qoq, (q.pct/nullif(y.before, 0) - 1)*100 AS yoy FROM ({near_sql(60, 150, DAYS)}) q JOIN ({near_sql(300, 450, DAYS)}) y ON q.ticker = y.ticker AND q.as_of = y.as_of")
QUERIES, ORACLE = R.queries, R.oracle
