"""Queries of the price-series operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from ..operators import series as S
from .registry import Registry

R = Registry()

R.add("win_01_daily_return", "symbol date ret~", lambda t: t.bars.withColumn("ret", S.daily_return(clip=0.35)), """
SELECT symbol, date, CASE WHEN lag(close) OVER w IS NOT NULL THEN least(greatest(close / lag(close) OVER w - 1, -0.35), 0.35) END AS ret FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)""")

ALIGNED_SQL = """
own AS (SELECT b.symbol, date, close, index_name FROM bars b JOIN membership m ON b.symbol = m.symbol),
grid AS (SELECT d.index_name, d.date, m.symbol FROM (SELECT DISTINCT index_name, date FROM own) d JOIN (SELECT DISTINCT index_name, symbol FROM own) m ON d.index_name = m.index_name),
filled AS (SELECT g.index_name, g.symbol, g.date, last_value(close IGNORE NULLS) OVER (PARTITION BY g.index_name, g.symbol ORDER BY g.date ROWS UNBOUNDED PRECEDING) AS close
  FROM grid g LEFT JOIN own o ON g.index_name = o.index_name AND g.symbol = o.symbol AND g.date = o.date),
aligned AS (SELECT index_name, symbol, date, close FROM (SELECT *, count(close) OVER w AS n, count(*) OVER w AS k FROM filled WINDOW w AS (PARTITION BY index_name, date)) WHERE n = k)"""
INDEX_SQL = ALIGNED_SQL + """,
rets AS (SELECT *, CASE WHEN lag(close) OVER v IS NOT NULL THEN least(greatest(close / lag(close) OVER v - 1, -0.35), 0.35) END AS r FROM aligned WINDOW v AS (PARTITION BY index_name, symbol ORDER BY date)),
idx AS (SELECT index_name, date, ret, 1000 * exp(sum(ln(1 + coalesce(ret, 0))) OVER (PARTITION BY index_name ORDER BY date ROWS UNBOUNDED PRECEDING)) AS level
  FROM (SELECT index_name, date, avg(r) AS ret FROM rets GROUP BY 1, 2))"""
RS_SQL = INDEX_SQL + """,
both_ AS (SELECT i.index_name, i.date, level, b.close AS bench, level / b.close AS ratio FROM idx i JOIN bench b ON i.date = b.date),
rs AS (SELECT *, 100 * ratio / first_value(ratio) OVER (PARTITION BY index_name ORDER BY date) AS rs FROM both_)"""


def index_levels(t):
    return S.equal_weight_levels(t.bars, t.membership)


R.add("win_04_aligned_panel", "index_name symbol date close~", lambda t: S.aligned(t.bars, t.membership), f"WITH {ALIGNED_SQL} SELECT * FROM aligned")
R.add("win_02_agg_29_equal_weight_index", "index_name date ret~ level~", index_levels, f"WITH {INDEX_SQL} SELECT * FROM idx")
R.add("win_03_index_filled_both_ways", "index_name date ret~ log_level~", lambda t: S.index_filled_both_ways(t.bars, t.membership, t.bench), """
WITH counts AS (SELECT index_name, b.symbol, count(close) AS k FROM bars b JOIN membership m ON b.symbol = m.symbol GROUP BY 1, 2 HAVING count(close) > 5),
enough AS (SELECT index_name FROM counts GROUP BY 1 HAVING count(*) >= 2),
own AS (SELECT c.index_name, b.symbol, date, close FROM bars b JOIN counts c ON b.symbol = c.symbol JOIN enough e ON c.index_name = e.index_name),
grid AS (SELECT d.index_name, d.date, m.symbol FROM (SELECT DISTINCT index_name, date FROM own) d JOIN (SELECT DISTINCT index_name, symbol FROM own) m ON d.index_name = m.index_name),
filled AS (SELECT g.index_name, g.symbol, g.date, coalesce(last_value(close IGNORE NULLS) OVER (PARTITION BY g.index_name, g.symbol ORDER BY g.date ROWS UNBOUNDED PRECEDING),
    first_value(close IGNORE NULLS) OVER (PARTITION BY g.index_name, g.symbol ORDER BY g.date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS close
  FROM grid g LEFT JOIN own o ON g.index_name = o.index_name AND g.symbol = o.symbol AND g.date = o.date),
mean AS (SELECT index_name, date, avg(r) AS ret FROM (SELECT *, coalesce(close / lag(close) OVER (PARTITION BY index_name, symbol ORDER BY date) - 1, 0) AS r FROM filled) GROUP BY 1, 2)
SELECT index_name, date, ret, ln((SELECT arg_min(close, date) FROM bench)) + sum(ln(1 + ret)) OVER (PARTITION BY index_name ORDER BY date ROWS UNBOUNDED PRECEDING) AS log_level FROM mean""")
R.add("jn_01_win_05_relative_strength", "index_name date ratio~ rs~", lambda t: S.relative_strength(index_levels(t), t.bench), f"WITH {RS_SQL} SELECT * FROM rs")
RANK_SQL = f"""WITH {RS_SQL},
newest AS (SELECT * FROM (SELECT *, coalesce(lag(rs, 19) OVER (PARTITION BY index_name ORDER BY date), first(rs) OVER (PARTITION BY index_name ORDER BY date)) AS before, row_number() OVER (PARTITION BY index_name ORDER BY date DESC) AS rn FROM rs) WHERE rn = 1),
s AS (SELECT index_name, rs - 100 AS rs_now, rs - before AS trend, level AS value, (level / 1000 - 1) * 100 AS change FROM newest)
SELECT *, CASE WHEN rs_now >= 0 THEN 'Outperforming' ELSE 'Underperforming' END AS status, rank() OVER (ORDER BY rs_now DESC) AS rank FROM s"""
R.add("win_06_rs_ranking", "index_name rs_now~ trend~ status value~ change~ rank#", lambda t: S.rs_ranking(S.relative_strength(index_levels(t), t.bench)), RANK_SQL)
R.add("top_01_sectors_by_rs", "index_name rs_now~ rank#", lambda t: S.rs_ranking(S.relative_strength(index_levels(t), t.bench)).orderBy("rank").limit(10), RANK_SQL + " QUALIFY rank <= 10")
R.add("top_06_rank_by_trend_number", "index_name trend~ place#", lambda t: S.rs_ranking(S.relative_strength(index_levels(t), t.bench)).withColumn("place", F.row_number().over(Window.orderBy(F.desc("trend"), "index_name"))), RANK_SQL.replace("rank() OVER (ORDER BY rs_now DESC) AS rank", "row_number() OVER (ORDER BY trend DESC, index_name) AS place"))


def mean_sql(c: str, n: int, key: str = "symbol") -> str:
    w = f"(PARTITION BY {key} ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({c}) OVER {w} = {n} THEN avg({c}) OVER {w} END"


RRG_SQL = "r1 AS (SELECT *, 100 * ratio / ({m1}) AS rs_ratio FROM {src}), r2 AS (SELECT *, 100 * rs_ratio / ({m2}) AS rs_momentum FROM r1)"
R.add("win_07_rs_ratio_momentum", "index_name date rs_ratio~ rs_momentum~", lambda t: S.rs_ratio_momentum(index_levels(t), t.bench, 10), f"WITH {RS_SQL}, {RRG_SQL.format(m1=mean_sql('ratio', 10, 'index_name'), m2=mean_sql('rs_ratio', 10, 'index_name'), src='rs')} SELECT * FROM r2")
BUCKET = {"D": "date", "W": "CAST(date + CAST((5 - isodow(date) + 7) % 7 AS INTEGER) AS date)", "M": "CAST(last_day(date) AS date)", "Q": "CAST(last_day(date_trunc('quarter', date) + INTERVAL 2 MONTH) AS date)"}


def rotation_sql(series: str, key: str, value: str) -> tuple[str, str]:
    """Common table expressions and the union of all timeframes."""
    ctes, parts = [], []
    for name, rule, n, tail in S.TIMEFRAMES:
        b, k = BUCKET[rule], name.lower()
        ctes.append(f"""{k}s AS (SELECT {key}, {b} AS bucket, arg_max({value}, date) AS v FROM {series} WHERE {value} IS NOT NULL GROUP BY 1, 2),
{k}b AS (SELECT {b} AS bucket, arg_max(close, date) AS v FROM bench GROUP BY 1),
{k}r AS (SELECT {key}, s.bucket AS date, s.v / b.v AS ratio FROM {k}s s JOIN {k}b b ON s.bucket = b.bucket),
{k}1 AS (SELECT *, 100 * ratio / ({mean_sql('ratio', n, key)}) AS rs_ratio FROM {k}r),
{k}2 AS (SELECT *, 100 * rs_ratio / ({mean_sql('rs_ratio', n, key)}) AS rs_momentum FROM {k}1),
{k}3 AS (SELECT '{name}' AS timeframe, {key}, date, row_number() OVER (PARTITION BY {key} ORDER BY date DESC) AS age, rs_ratio, rs_momentum,
  CASE WHEN rs_ratio >= 100 AND rs_momentum >= 100 THEN 'Leading' WHEN rs_ratio >= 100 THEN 'Weakening' WHEN rs_momentum < 100 THEN 'Lagging' ELSE 'Improving' END AS quadrant
  FROM {k}2 WHERE rs_momentum IS NOT NULL)""")
        parts.append(f"SELECT * FROM {k}3 WHERE age <= {tail}")
    return ",\n".join(ctes), " UNION ALL ".join(parts)


ROT = rotation_sql("idx", "index_name", "level")
R.add("win_08_flt_09_rotation_timeframes", "timeframe index_name date age# rs_ratio~ rs_momentum~ quadrant", lambda t: S.rotation(index_levels(t), t.bench, "index_name", "level"), f"WITH {INDEX_SQL}, {ROT[0]} SELECT * FROM ({ROT[1]}) q")
for rule, word in (("W", "week"), ("M", "month"), ("Q", "quarter")):
    R.add(f"win_09_resample_{word}", "symbol date close~", lambda t, rule=rule: S.resampled(t.bars, rule, "symbol", "close"), f"SELECT symbol, {BUCKET[rule]} AS date, arg_max(close, date) AS close FROM bars GROUP BY 1, 2")
ROT_B = rotation_sql("bars", "symbol", "close")
R.add("win_10_top_07_constituent_tails", "timeframe symbol points# newest date", lambda t: S.rotation(t.bars, t.bench, "symbol", "close").groupBy("timeframe", "symbol").agg(F.count("*").alias("points"), F.min_by("quadrant", "age").alias("newest"), F.max("date").alias("date")),
      f"WITH {ROT_B[0]} SELECT timeframe, symbol, count(*) AS points, arg_min(quadrant, age) AS newest, max(date) AS date FROM ({ROT_B[1]}) q GROUP BY 1, 2")

W = "WINDOW w AS (PARTITION BY symbol ORDER BY date)"
SIGNALS_SQL = f"""SELECT symbol, close, (close/ma50-1)*100 AS vs_50, (close/ma100-1)*100 AS vs_100, (close/ma200-1)*100 AS vs_200, (close/hi52-1)*100 AS vs_52w_high, (close/c3-1)*100 AS ret_3m, (close/c6-1)*100 AS ret_6m,
  close/bench / (c3/b3) * 100 AS rs_3m, volume/v50 AS volume_spike, coalesce(close < c1 AND volume > 2*v50, false) AS down_volume FROM (
  SELECT b.*, n.close AS bench, {mean_sql('b.close', 50)} AS ma50, {mean_sql('b.close', 100)} AS ma100, {mean_sql('b.close', 200)} AS ma200, {mean_sql('volume', 50)} AS v50,
  max(b.close) OVER (PARTITION BY symbol ORDER BY b.date ROWS 251 PRECEDING) AS hi52, lag(n.close, 64) OVER w AS b3, lag(b.close, 64) OVER w AS c3, lag(b.close, 129) OVER w AS c6, lag(b.close) OVER w AS c1,
  row_number() OVER (PARTITION BY symbol ORDER BY b.date DESC) AS rn FROM bars b JOIN bench n ON b.date = n.date WINDOW w AS (PARTITION BY symbol ORDER BY b.date)) AS signal_rows WHERE rn = 1"""
SIGNALS_SQL = SIGNALS_SQL.replace("ORDER BY date", "ORDER BY b.date")
R.add("win_11_position_signals", "symbol close~ vs_50~ vs_100~ vs_200~ vs_52w_high~ ret_3m~ ret_6m~ rs_3m~ volume_spike~ down_volume", lambda t: S.position_signals(t.bars, t.bench), SIGNALS_SQL)
R.add("win_12_quotes", "symbol last~ prev~ chg_1d~ chg_5d~", lambda t: t.bars.withColumn("prev", F.lag("close").over(S.by_symbol())).withColumn("c5", F.lag("close", 5).over(S.by_symbol())).withColumn("rn", F.row_number().over(S.from_end())).where("rn = 1").select("symbol", F.col("close").alias("last"), "prev", ((ratio("close", "prev") - 1) * 100).alias("chg_1d"), ((ratio("close", "c5") - 1) * 100).alias("chg_5d")), f"""
SELECT symbol, close AS last, prev, (close/prev-1)*100 AS chg_1d, (close/c5-1)*100 AS chg_5d FROM (SELECT *, lag(close) OVER w AS prev, lag(close,5) OVER w AS c5, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM bars {W}) WHERE rn = 1""")
TR = "greatest(high-low, abs(high-lag(close) OVER w), abs(low-lag(close) OVER w))"
R.add("win_13_atr", "symbol date atr~", lambda t: S.atr(t.bars, 14), f"WITH x AS (SELECT *, {TR} AS tr FROM bars {W}) SELECT symbol, date, {mean_sql('tr', 14)} AS atr FROM x")
R.add("win_14_on_balance_volume", "symbol date obv~", lambda t: t.bars.withColumn("diff", F.col("close") - F.lag("close").over(S.by_symbol())).withColumn("obv", S.on_balance_volume()), f"WITH x AS (SELECT *, close - lag(close) OVER w AS diff FROM bars {W}) SELECT symbol, date, sum(sign(coalesce(diff,0))*volume) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS obv FROM x")
R.add("win_15_slope", "symbol slope~ n#", lambda t: S.slope_of_last(t.bars, "close", 20), "WITH x AS (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM bars) SELECT symbol, CASE WHEN count(*) < 5 THEN 0 ELSE regr_slope(close, -rn) END AS slope, count(*) AS n FROM x WHERE rn <= 20 GROUP BY 1")


def rs_rising(t, n=50):
    both = t.bars.join(t.bench.select("date", F.col("close").alias("bench")), "date").withColumn("rn", F.row_number().over(S.from_end())).where(F.col("rn") <= n)
    first = both.groupBy("symbol").agg(F.min_by(ratio("close", "bench"), "date").alias("r0"), F.count("*").alias("k"), F.regr_slope(ratio("close", "bench"), -F.col("rn")).alias("s"))
    return first.select("symbol", F.when(F.col("k") >= n, ratio("s", "r0")).otherwise(0.0).alias("slope")).withColumn("rising", F.col("slope") > 0)


R.add("win_16_rs_rising", "symbol slope~ rising", rs_rising, "WITH x AS (SELECT symbol, b.date, b.close / n.close AS ratio, row_number() OVER (PARTITION BY symbol ORDER BY b.date DESC) AS rn FROM bars b JOIN bench n ON b.date = n.date), y AS (SELECT symbol, CASE WHEN count(*) >= 50 THEN regr_slope(ratio, -rn) / arg_min(ratio, date) ELSE 0 END AS slope FROM x WHERE rn <= 50 GROUP BY 1) SELECT *, slope > 0 AS rising FROM y")
R.add("win_17_fractal_pivots", "symbol date high~ k3 k8", lambda t: t.bars.withColumn("k3", S.fractal_high(3)).withColumn("k8", S.fractal_high(8)).where("k3 or k8"), """
SELECT * FROM (SELECT *, count(*) OVER a = 7 AND high = max(high) OVER a AS k3, count(*) OVER b = 17 AND high = max(high) OVER b AS k8 FROM bars
WINDOW a AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), b AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING)) WHERE k3 OR k8""")
R.add("win_18_swing_lows", "symbol date low~", lambda t: t.bars.withColumn("s", S.swing_low(5)).where("s"), "SELECT * FROM (SELECT *, count(*) OVER a = 11 AND low <= min(low) OVER a AS s FROM bars WINDOW a AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)) WHERE s")
R.add("win_19_technical_structure", "symbol date rsi~ ma50~ ma200~ golden_cross vs_200~ volume_trend trend", lambda t: S.technical_structure(t.bars), f"""
WITH x AS (SELECT *, close - lag(close) OVER w AS d FROM bars {W}), g AS (SELECT *, CASE WHEN d > 0 THEN d ELSE 0 END AS up, CASE WHEN d < 0 THEN -d ELSE 0 END AS down FROM x),
y AS (SELECT *, {mean_sql('up', 14)} AS gain, {mean_sql('down', 14)} AS loss, {mean_sql('close', 50)} AS ma50, {mean_sql('close', 200)} AS ma200, {mean_sql('volume', 20)} AS v20, {mean_sql('volume', 50)} AS v50,
 row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM g),
z AS (SELECT *, CASE WHEN loss = 0 THEN 50 ELSE 100 - 100 / (1 + gain/loss) END AS rsi FROM y WHERE rn = 1 AND n >= 200)
SELECT symbol, date, rsi, ma50, ma200, ma50 > ma200 AS golden_cross, (close/ma200 - 1)*100 AS vs_200,
 CASE WHEN NOT v50 > 0 THEN 'N/A' WHEN v20/v50 > 1.3 THEN 'RISING (accumulation)' WHEN v20/v50 < 0.7 THEN 'FALLING (distribution)' ELSE 'NORMAL' END AS volume_trend,
 CASE WHEN close > ma200 AND ma50 > ma200 AND rsi > 50 THEN 'STRONG UPTREND' WHEN close > ma200 AND rsi > 40 THEN 'UPTREND' WHEN close <= ma200 AND ma50 <= ma200 AND rsi < 50 THEN 'DOWNTREND' WHEN close <= ma200 THEN 'WEAK' ELSE 'SIDEWAYS' END AS trend FROM z""")
R.add("win_20_multi_horizon_alpha", "symbol a21~ a63~ a126~ a252~ alpha~ outperforming", lambda t: S.multi_horizon_alpha(t.bars, t.bench), f"""
WITH x AS (SELECT b.symbol, b.date, b.close, n.close AS bench FROM bars b JOIN bench n ON b.date = n.date),
y AS (SELECT *, {', '.join(f'((close/lag(close,{h - 1}) OVER w - 1) - (bench/lag(bench,{h - 1}) OVER w - 1))*100 AS a{h}' for h in (21, 63, 126, 252))}, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM x {W}),
z AS (SELECT *, coalesce((coalesce(a21,0)+coalesce(a63,0)+coalesce(a126,0)+coalesce(a252,0)) / nullif((a21 IS NOT NULL)::INT+(a63 IS NOT NULL)::INT+(a126 IS NOT NULL)::INT+(a252 IS NOT NULL)::INT, 0), 0) AS alpha FROM y WHERE rn = 1 AND n >= 20)
SELECT *, alpha > 0 AS outperforming FROM z""")
R.add("win_21_mansfield", "symbol date mansfield~", lambda t: S.mansfield(t.bars, t.bench), "WITH x AS (SELECT b.symbol, b.date, b.close / n.close AS ratio FROM bars b ASOF JOIN bench n ON b.date >= n.date) SELECT symbol, date, (ratio / avg(ratio) OVER (PARTITION BY symbol ORDER BY date ROWS 251 PRECEDING) - 1)*100 AS mansfield FROM x")
R.add("jn_11_benchmark_as_of", "symbol date close~ bench~", lambda t: S.as_of(t.bars.select("symbol", "date", "close"), t.bench.where(F.dayofmonth("date") == 1)), "WITH m AS (SELECT * FROM bench WHERE day(date) = 1) SELECT b.symbol, b.date, b.close, m.close AS bench FROM bars b ASOF LEFT JOIN m ON b.date >= m.date")
R.add("win_31_higher_lows", "symbol base~ steps# holds", lambda t: S.higher_lows(t.bars), """
WITH x AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn, count(*) OVER a = 7 AND low <= min(low) OVER a AS swing FROM bars WINDOW a AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
r AS (SELECT * FROM x WHERE rn <= 50), b AS (SELECT symbol, arg_min(date, low) AS base_date, min(low) AS base, arg_max(low, date) AS last_low FROM r GROUP BY 1),
s AS (SELECT r.symbol, low, greatest(coalesce(max(low) OVER (PARTITION BY r.symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), base), base) AS best FROM r JOIN b ON r.symbol = b.symbol WHERE swing AND date > base_date),
c AS (SELECT symbol, count(*) AS steps, max(low) AS top FROM s WHERE low > best GROUP BY 1)
SELECT b.symbol, base, coalesce(steps, 0) AS steps, last_low > coalesce(top, base) AS holds FROM b LEFT JOIN c ON b.symbol = c.symbol""")
R.add("agg_05_breadth", "date n# above_50~ above_200~ new_highs# new_lows# advances# declines# high_low_ratio~ ad_ratio~", lambda t: S.breadth(t.bars), f"""
WITH x AS (SELECT *, {mean_sql('close', 50)} AS ma50, {mean_sql('close', 200)} AS ma200, CASE WHEN count(close) OVER y >= 200 THEN max(close) OVER y END AS hi, CASE WHEN count(close) OVER y >= 200 THEN min(close) OVER y END AS lo, lag(close) OVER w AS before,
  count(close) OVER (PARTITION BY symbol) AS k FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date), y AS (PARTITION BY symbol ORDER BY date ROWS 251 PRECEDING)),
c AS (SELECT date, count(*) AS n, 100.0*count(*) FILTER (close > ma50)/nullif(count(ma50),0) AS above_50, 100.0*count(*) FILTER (close > ma200)/nullif(count(ma200),0) AS above_200, count(*) FILTER (close >= hi*0.999) AS new_highs, count(*) FILTER (close <= lo*1.001) AS new_lows,
  count(*) FILTER (close > before) AS advances, count(*) FILTER (close < before) AS declines FROM x WHERE k >= 50 GROUP BY 1)
SELECT *, new_highs/nullif(new_lows, 0)::DOUBLE AS high_low_ratio, advances/nullif(declines, 0)::DOUBLE AS ad_ratio FROM c""")
R.add("agg_19_index_summary", "index_name first_date last_date sessions# current~ high~ low~ change~", lambda t: index_levels(t).groupBy("index_name").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("sessions"), F.max_by("level", "date").alias("current"), F.max("level").alias("high"), F.min("level").alias("low"), ((ratio(F.max_by("level", "date"), F.min_by("level", "date")) - 1) * 100).alias("change")), f"""
WITH {INDEX_SQL} SELECT index_name, min(date) AS first_date, max(date) AS last_date, count(*) AS sessions, arg_max(level, date) AS current, max(level) AS high, min(level) AS low, (arg_max(level,date)/arg_min(level,date)-1)*100 AS change FROM idx GROUP BY 1""")
R.add("flt_07_trend_gate", "symbol passes", lambda t: t.bars.withColumn("ma50", S.full_mean("close", 50)).withColumn("n", F.count("*").over(Window.partitionBy("symbol"))).withColumn("rn", F.row_number().over(S.from_end())).where("rn = 1").select("symbol", F.coalesce((F.col("n") >= 60) & (F.col("close") > F.col("ma50")), F.lit(False)).alias("passes")), f"""
SELECT symbol, coalesce(n >= 60 AND close > ma50, false) AS passes FROM (SELECT *, {mean_sql('close', 50)} AS ma50, count(*) OVER (PARTITION BY symbol) AS n, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM bars) WHERE rn = 1""")
QUERIES, ORACLE = R.queries, R.oracle
