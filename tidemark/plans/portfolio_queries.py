"""Queries of the portfolio operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from ..operators import portfolio as P
from ..operators import series as S
from .registry import Registry
from .series_queries import SIGNALS_SQL

R = Registry()
R.add("agg_01_portfolio_totals", "portfolio invested$ present~ pnl~ ret~ winners# losers# win_rate~ best worst", lambda t: P.totals(t.holdings), """
SELECT portfolio, sum(invested) AS invested, sum(present) AS present, sum(pnl) AS pnl, 100*sum(pnl)/sum(invested) AS ret, count(*) FILTER (pnl > 0) AS winners, count(*) FILTER (pnl < 0) AS losers,
 100.0*count(*) FILTER (pnl > 0)/count(*) AS win_rate, arg_max(symbol, pnl/invested) AS best, arg_min(symbol, pnl/invested) AS worst FROM holdings GROUP BY 1""")
R.add("agg_02_sector_exposure", "portfolio sector n# invested$ weight~ ret~", lambda t: P.sector_exposure(t.holdings), """
SELECT portfolio, sector, n, invested, 100*present/sum(present) OVER (PARTITION BY portfolio) AS weight, (present/invested-1)*100 AS ret FROM (SELECT portfolio, sector, count(*) AS n, sum(invested) AS invested, sum(present) AS present FROM holdings GROUP BY 1, 2)""")
R.add("agg_03_position_weights", "portfolio symbol weight~", lambda t: P.weights(t.holdings), "SELECT portfolio, symbol, present/sum(present) OVER (PARTITION BY portfolio) AS weight FROM holdings")
R.add("agg_04_collapse_by_symbol", "portfolio symbol sector quantity# present~", lambda t: P.collapse(t.holdings.unionByName(t.holdings.where("symbol % 2 = 0"))), """
SELECT portfolio, symbol, min(sector) AS sector, sum(quantity) AS quantity, sum(present) AS present FROM (SELECT * FROM holdings UNION ALL SELECT * FROM holdings WHERE symbol % 2 = 0) GROUP BY 1, 2""")
R.add("win_34_concentration", "portfolio symbol rank# weight~ running~", lambda t: P.concentration(t.holdings), """
SELECT * FROM (SELECT portfolio, symbol, weight, row_number() OVER w AS rank, sum(weight) OVER (PARTITION BY portfolio ORDER BY present DESC, symbol ROWS UNBOUNDED PRECEDING) AS running FROM (SELECT *, present/sum(present) OVER (PARTITION BY portfolio) AS weight FROM holdings) WINDOW w AS (PARTITION BY portfolio ORDER BY present DESC, symbol)) WHERE rank <= 10""")
R.add("agg_12_beta_volatility_drawdown", "symbol beta~ volatility~ max_drawdown~ n#", lambda t: P.beta_table(t.bars, t.bench), """
WITH r AS (SELECT symbol, date, close/lag(close) OVER w - 1 AS r, close/max(close) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
b AS (SELECT date, close/lag(close) OVER (ORDER BY date) - 1 AS br FROM bench)
SELECT symbol, covar_samp(r, br)/(SELECT var_samp(br) FROM b) AS beta, stddev_samp(r)*sqrt(252)*100 AS volatility, min(dd)*100 AS max_drawdown, count(*) FILTER (r IS NOT NULL AND br IS NOT NULL) AS n FROM r LEFT JOIN b ON r.date = b.date GROUP BY 1 HAVING count(*) FILTER (r IS NOT NULL AND br IS NOT NULL) >= 30""")
RET = "r AS (SELECT symbol, date, close/lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS r FROM bars)"
PR = f"{RET}, pw AS (SELECT portfolio, symbol, present/sum(present) OVER (PARTITION BY portfolio) AS weight FROM holdings), p AS (SELECT portfolio, date, sum(weight*coalesce(r, 0)) AS r FROM pw JOIN r ON pw.symbol = r.symbol GROUP BY 1, 2)"
R.add("agg_13_portfolio_returns", "date n# mean~ low~ high~", lambda t: P.return_spread(t.holdings, t.bars), f"WITH {PR} SELECT date, count(*) AS n, avg(r) AS mean, min(r) AS low, max(r) AS high FROM p GROUP BY 1")
# Prices of the given tables are unrelated from day to day. So that yearly returns stay numbers of a common size, portfolios are invested to a fiftieth and the benchmark stands on a base.
CALM = lambda t: t.bench.withColumn("close", F.col("close") + 50000)
RISK = lambda t: P.holdings_risk(t.holdings, t.bars, CALM(t), P.beta_table(t.bars, CALM(t)), 1 / 50)
R.add(
    "agg_14_win_22_win_23_risk_summary",
    "portfolio days# beta~ annual$ bench_annual~ excess$ volatility~ sharpe~ max_drawdown~ var_1d~ var_5d~ var_parametric~ best_day~ worst_day~",
    RISK,
    f"""
WITH {PR}, b AS (SELECT date, (close + 50000)/(lag(close) OVER (ORDER BY date) + 50000) - 1 AS br FROM bench QUALIFY br IS NOT NULL),
betas AS (SELECT symbol, covar_samp(r, br) / (SELECT var_samp(br) FROM b) AS beta FROM r JOIN b ON r.date = b.date WHERE r IS NOT NULL GROUP BY 1 HAVING count(*) >= 30),
pb AS (SELECT portfolio, sum(weight * beta) / sum(weight) AS beta FROM pw JOIN betas USING (symbol) WHERE beta IS NOT NULL GROUP BY 1),
q AS (SELECT portfolio, date, r / 50 AS r, br FROM p JOIN b USING (date)),
x AS (SELECT *, sum(ln(1 + r)) OVER (PARTITION BY portfolio ORDER BY date ROWS UNBOUNDED PRECEDING) AS log_nav, CASE WHEN count(r) OVER v = 5 THEN sum(r) OVER v END AS r5 FROM q WINDOW v AS (PARTITION BY portfolio ORDER BY date ROWS 4 PRECEDING)),
y AS (SELECT *, exp(log_nav) / max(exp(log_nav)) OVER (PARTITION BY portfolio ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM x),
z AS (SELECT portfolio, count(*) AS days, (exp(sum(ln(1 + r)) * 252 / count(*)) - 1) * 100 AS annual, (exp(sum(ln(1 + br)) * 252 / count(*)) - 1) * 100 AS bench_annual, stddev_samp(r) * sqrt(252) * 100 AS volatility, min(dd) * 100 AS max_drawdown,
  -quantile_cont(r, 0.05) * 100 AS var_1d, -quantile_cont(r5, 0.05) * 100 AS var_5d, 1.645 * stddev_samp(r) * 100 AS var_parametric, max(r) * 100 AS best_day, min(r) * 100 AS worst_day FROM y GROUP BY 1)
SELECT z.*, beta, annual - bench_annual AS excess, annual / volatility AS sharpe FROM z LEFT JOIN pb USING (portfolio)""",
)
CORR = f"{RET}, c AS (SELECT a.symbol AS a, b.symbol AS b, corr(a.r, b.r) AS corr, count(*) AS n FROM r a JOIN r b ON a.date = b.date AND a.symbol < b.symbol WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 30)"
R.add("agg_15_pair_correlations", "a b corr~ n#", lambda t: P.pair_correlations(t.bars), f"WITH {CORR} SELECT * FROM c")
R.add("jn_14_strong_pairs", "portfolio a b corr~ wa~ wb~", lambda t: P.strong_pairs(t.bars, t.holdings, 0.2), f"""
WITH {CORR}, pw AS (SELECT portfolio, symbol, present/sum(present) OVER (PARTITION BY portfolio) AS weight FROM holdings) SELECT x.portfolio, a, b, corr, x.weight AS wa, y.weight AS wb FROM c JOIN pw x ON a = x.symbol JOIN pw y ON b = y.symbol AND x.portfolio = y.portfolio WHERE corr >= 0.2""")
R.add("agg_16_ud_02_greedy_clusters", "portfolio cluster# members size# weight~ avg_corr~", lambda t: P.strong_clusters(t.bars, t.holdings, 0.1))


def health_rows(t):
    """Positions without enough closes have no signals, and nothing then speaks against them."""
    p = t.positions.join(S.position_signals(t.bars, t.bench), "symbol", "left").withColumn("from_cost", F.when(F.col("avg_cost") > 0, (ratio("close", "avg_cost") - 1) * 100))
    return p.select("portfolio", "symbol", P.health(*map(F.col, ("vs_200", "vs_100", "vs_50", "rs_3m", "from_cost", "down_volume"))).alias("health"))


HEALTH_SQL = f"""
SELECT portfolio, p.symbol, CASE WHEN vs_200 < 0 THEN 'ACTION' WHEN (close/avg_cost-1)*100 <= -25 THEN 'ACTION' WHEN rs_3m < 90 AND vs_100 < 0 THEN 'ACTION' WHEN vs_50 < 0 THEN 'WATCH' WHEN rs_3m < 100 THEN 'WATCH' WHEN down_volume THEN 'WATCH' ELSE 'OK' END AS health
FROM positions p JOIN ({SIGNALS_SQL}) s ON p.symbol = s.symbol"""
R.add("flt_10_position_health", "portfolio symbol health", health_rows, HEALTH_SQL)
R.add("top_05_custom_label_order", "portfolio symbol health place#", lambda t: health_rows(t).withColumn("label_order", P.label_order("health", ("ACTION", "WATCH", "OK"))).withColumn("place", F.row_number().over(Window.partitionBy("portfolio").orderBy("label_order", "symbol"))), f"SELECT *, row_number() OVER (PARTITION BY portfolio ORDER BY CASE health WHEN 'ACTION' THEN 1 WHEN 'WATCH' THEN 2 ELSE 3 END, symbol) AS place FROM ({HEALTH_SQL})")
PLEDGE = lambda t: t.table("supplier").select(F.col("s_suppkey").alias("symbol"), F.when(F.col("s_suppkey") % 7 != 0, F.pmod("s_acctbal", F.lit(40.0))).alias("pledged"), F.when(F.col("s_suppkey") % 5 != 0, 20 + F.pmod(F.col("s_acctbal") * 3, F.lit(60.0))).alias("promoter"))
PLEDGE_SQL = "SELECT s_suppkey AS symbol, CASE WHEN s_suppkey % 7 <> 0 THEN ((s_acctbal % 40.0) + 40.0) % 40.0 END AS pledged, CASE WHEN s_suppkey % 5 <> 0 THEN 20 + (((s_acctbal*3) % 60.0) + 60.0) % 60.0 END AS promoter FROM supplier"
FLAG_SQL = "CASE WHEN coalesce(pledged,0) > 25 OR coalesce(promoter,100) < 30 THEN 'RED' WHEN coalesce(pledged,0) > 10 OR coalesce(promoter,100) < 40 THEN 'AMBER' ELSE 'OK' END"
R.add("flt_11_pledge_flag", "symbol pledged~ promoter~ flag", lambda t: PLEDGE(t).withColumn("flag", P.pledge_flag("pledged", "promoter")), f"SELECT *, {FLAG_SQL} AS flag FROM ({PLEDGE_SQL})")
R.add("jn_03_positions_with_screener_facts", "portfolio symbol pledged~ flag", lambda t: t.positions.join(PLEDGE(t), "symbol", "left").withColumn("flag", P.pledge_flag("pledged", "promoter")), f"SELECT portfolio, p.symbol, pledged, {FLAG_SQL} AS flag FROM positions p LEFT JOIN ({PLEDGE_SQL}) s ON p.symbol = s.symbol")


def levels(t):
    """User levels as a table: some symbols have none, a stop only, a target only, or both."""
    b = t.last_close
    stop = F.when(F.col("symbol") % 4 != 0, F.col("last_close") * (0.9 + (F.col("symbol") % 12) / 100.0))
    target = F.when(F.col("symbol") % 3 != 0, F.col("last_close") * (0.99 + (F.col("symbol") % 10) / 100.0))
    return b.where("symbol % 6 <> 5").select("symbol", stop.alias("stop"), target.alias("target"))


LEVELS_SQL = "SELECT symbol, CASE WHEN symbol % 4 <> 0 THEN last_close*(0.9 + (symbol % 12)/100.0) END AS stop, CASE WHEN symbol % 3 <> 0 THEN last_close*(0.99 + (symbol % 10)/100.0) END AS target FROM last_closes WHERE symbol % 6 <> 5"
R.add("jn_02_positions_with_levels", "portfolio symbol stop~ target~", lambda t: t.positions.join(levels(t), "symbol", "left"), f"SELECT portfolio, p.symbol, stop, target FROM positions p LEFT JOIN ({LEVELS_SQL}) l ON p.symbol = l.symbol")
R.add("flt_12_stop_target_status", "portfolio symbol status", lambda t: t.positions.join(levels(t), "symbol", "left").join(t.last_close, "symbol", "left").withColumn("status", P.level_status("last_close", "stop", "target")), f"""
SELECT portfolio, p.symbol, CASE WHEN last_close IS NULL THEN 'NO_PRICE' WHEN stop IS NULL AND target IS NULL THEN 'NO_LEVELS' WHEN last_close <= stop THEN 'STOP_HIT' WHEN last_close >= target THEN 'TARGET_HIT' WHEN (last_close-stop)/last_close*100 <= 3 THEN 'NEAR_STOP' WHEN (target-last_close)/last_close*100 <= 3 THEN 'NEAR_TARGET' ELSE 'OK' END AS status
FROM positions p LEFT JOIN ({LEVELS_SQL}) l ON p.symbol = l.symbol LEFT JOIN last_closes c ON p.symbol = c.symbol""")
R.add("src_30_missing_levels_template", "symbol stop~ target~", lambda t: levels(t).unionByName(t.positions.select("symbol").distinct().join(levels(t), "symbol", "left_anti"), allowMissingColumns=True), f"SELECT * FROM ({LEVELS_SQL}) UNION ALL SELECT DISTINCT symbol, NULL, NULL FROM positions WHERE symbol NOT IN (SELECT symbol FROM ({LEVELS_SQL}))")
QUERIES, ORACLE = R.queries, R.oracle
