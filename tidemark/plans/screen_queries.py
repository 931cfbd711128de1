"""Queries of screens, patterns and reviews.

PAT-2 to PAT-7 take a level that SQL can state as well: the highest high of
the newest 120 sessions, with the base starting there. The scan itself takes
the detected level.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from ..operators import screen as C
from ..operators import series as S
from .registry import Registry

R = Registry()


def simple_level(t, n: int = 120):
    x = t.bars.withColumn("rn", F.row_number().over(S.from_end())).where(F.col("rn") <= n)
    return x.groupBy("symbol").agg(F.max("high").alias("level"), F.min("date").alias("base_start"), F.max_by("close", "date").alias("last_close"))


def base(t):
    return C.base_rows(t.bars, simple_level(t))


BASE = """x AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM bars),
lv AS (SELECT symbol, max(high) AS level, min(date) AS base_start, arg_max(close, date) AS last_close FROM x WHERE rn <= 120 GROUP BY 1),
base AS (SELECT x.*, level, last_close, row_number() OVER (PARTITION BY x.symbol ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY x.symbol) AS m FROM x JOIN lv ON x.symbol = lv.symbol WHERE date >= base_start)"""
R.add("pat_02_base_geometry", "symbol range_pct~ trailing_pct~ is_flat", lambda t: C.base_geometry(base(t)), f"WITH {BASE} SELECT symbol, (max(high)-min(low))/max(level) AS range_pct, (max(high) FILTER (rn <= 25) - min(low) FILTER (rn <= 25))/max(level) AS trailing_pct, (max(high) FILTER (rn <= 25) - min(low) FILTER (rn <= 25))/max(level) <= 0.10 AS is_flat FROM base GROUP BY 1")
R.add("pat_03_failed_breakout", "symbol failed_breakout", lambda t: C.failed_breakout(t.bars, simple_level(t).withColumn("level", F.col("level") * 0.9)), f"WITH {BASE} SELECT x.symbol, bool_or(high > 0.9*level*1.03) AND bool_or(last_close < 0.9*level*0.98) AS failed_breakout FROM x JOIN lv ON x.symbol = lv.symbol WHERE rn <= 15 GROUP BY 1")
R.add("pat_04_recent_test", "symbol recent_touches#", lambda t: C.recent_test(t.bars, simple_level(t).withColumn("level", F.col("level") * 0.8)), f"WITH {BASE}, n AS (SELECT symbol, count(*) AS n FROM bars GROUP BY 1) SELECT x.symbol, count(*) FILTER (n >= 60 AND high >= level*0.8*0.96) AS recent_touches FROM x JOIN lv ON x.symbol = lv.symbol JOIN n ON x.symbol = n.symbol WHERE rn <= 50 GROUP BY 1")
R.add("pat_05_cup_and_handle", "symbol cup_handle", lambda t: C.cup_and_handle(base(t)), f"""WITH {BASE}, y AS (SELECT symbol, max(m) AS m, max(level) AS level, max(last_close) AS c, max(high) FILTER (i < m-5) AS hi, min(low) FILTER (i < m-5) AS lo, min(low) FILTER (i < m-5 AND i >= greatest((m-5)//3, 1) AND i < 2*greatest((m-5)//3, 1)) AS mid, min(low) FILTER (rn <= 15) AS handle FROM base GROUP BY 1)
SELECT symbol, coalesce(m >= 50 AND (hi-lo)/hi BETWEEN 0.12 AND 0.40 AND mid <= lo*1.05 AND (hi-handle)/hi <= (hi-lo)/hi*0.5 AND abs(level-c)/c <= 0.08, false) AS cup_handle FROM y""")
R.add("pat_06_vcp_contractions", "symbol n_vcp#", lambda t: C.vcp(base(t)), f"""WITH {BASE}, p AS (SELECT *, count(*) OVER w = 11 AND high = max(high) OVER w AS is_pivot FROM base WHERE m >= 30 WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
pv AS (SELECT symbol, i, high, lead(i) OVER (PARTITION BY symbol ORDER BY i) AS nxt FROM p WHERE is_pivot), pull AS (SELECT symbol, i, (high - (SELECT min(low) FROM base b WHERE b.symbol = pv.symbol AND b.i BETWEEN pv.i AND pv.nxt))/high AS pull FROM pv WHERE nxt IS NOT NULL),
q AS (SELECT *, lag(pull) OVER (PARTITION BY symbol ORDER BY i) AS before FROM pull) SELECT s.symbol, coalesce((SELECT count(*) FROM q WHERE q.symbol = s.symbol AND pull < before*0.85 AND pull < 0.15), 0) AS n_vcp FROM lv s""")
R.add("pat_07_double_bottom", "symbol w_pattern", lambda t: C.double_bottom(base(t)), f"""WITH {BASE}, p AS (SELECT *, count(*) OVER w = 9 AND low = min(low) OVER w AS swing FROM base WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)), l AS (SELECT * FROM p WHERE swing AND m >= 25),
pr AS (SELECT a.symbol, least(a.low, b.low) AS lo, greatest(a.low, b.low) AS hi, a.level, a.last_close AS c, (SELECT max(high) FROM base h WHERE h.symbol = a.symbol AND h.i > a.i AND h.i < b.i) AS peak FROM l a JOIN l b ON a.symbol = b.symbol AND b.i - a.i >= 5),
f AS (SELECT symbol, bool_or((hi-lo)/lo <= 0.04 AND (peak-lo)/lo >= 0.05 AND (c >= peak*0.97 OR (level-c)/c BETWEEN -0.05 AND 0.04)) AS w FROM pr GROUP BY 1) SELECT lv.symbol, coalesce(w, false) AS w_pattern FROM lv LEFT JOIN f ON lv.symbol = f.symbol""")
TR = "greatest(high-low, abs(high-lag(close) OVER w), abs(low-lag(close) OVER w))"
R.add("flt_08_not_extended", "symbol calm", lambda t: C.not_extended(t.bars, 0.5), f"""WITH x AS (SELECT *, {TR} AS tr, abs(close/lag(close) OVER w - 1) AS r, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
g AS (SELECT symbol, count(*) AS n, max(r) FILTER (rn <= 5) AS r5, avg(tr) FILTER (rn <= 20) AS a, max(high-low) FILTER (rn = 1) AS range FROM x GROUP BY 1) SELECT symbol, n >= 25 AND NOT coalesce(r5 > 0.5, false) AND coalesce(a <= 0 OR range <= a*2.5, true) AS calm FROM g""")
SCREEN_SQL = """WITH t AS (SELECT max(date) - INTERVAL 12 MONTH AS cutoff FROM bars),
x AS (SELECT *, max(high) FILTER (date >= cutoff) OVER z AS hi52, min(low) FILTER (date >= cutoff) OVER z AS lo52, coalesce(arg_min(close, date) FILTER (date >= cutoff) OVER z, first_value(close) OVER w) AS c1y, lag(close, 49) OVER w AS c50, CASE WHEN count(close) OVER d = 200 THEN avg(close) OVER d END AS ma200,
 row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn, count(*) OVER a = 7 AND low <= min(low) OVER a AS swing FROM bars, t WINDOW w AS (PARTITION BY symbol ORDER BY date), z AS (PARTITION BY symbol), d AS (PARTITION BY symbol ORDER BY date ROWS 199 PRECEDING), a AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
b AS (SELECT symbol, arg_min(date, low) AS base_date, min(low) AS base, arg_max(low, date) AS last_low FROM x WHERE rn <= 50 GROUP BY 1),
s AS (SELECT x.symbol, low, greatest(coalesce(max(low) OVER (PARTITION BY x.symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), base), base) AS best FROM x JOIN b ON x.symbol = b.symbol WHERE swing AND rn <= 50 AND date > base_date),
c AS (SELECT symbol, count(*) AS steps, max(low) AS top FROM s WHERE low > best GROUP BY 1),
f AS (SELECT x.symbol, close, ma200, hi52, close/hi52*100-100 AS off_high, close/lo52*100-100 AS off_low, close/c1y*100-100 AS runup, close/c50*100-100 AS ret_rs, coalesce(steps, 0) + CAST(last_low > coalesce(top, base) AS INT) AS steps FROM x JOIN b ON x.symbol = b.symbol LEFT JOIN c ON x.symbol = c.symbol WHERE rn = 1),
r AS (SELECT *, CASE WHEN close < 45 THEN 'price' WHEN hi52 IS NULL THEN 'no_52w_high' WHEN NOT (off_high BETWEEN -90 AND -2) THEN 'band52w' WHEN off_low <= 20 THEN 'low52w' WHEN runup > 300 THEN 'runup' WHEN ret_rs <= 0 THEN 'rs' WHEN ma200 IS NULL THEN 'short_history' WHEN close <= ma200 THEN 'below_200dma' WHEN steps < 1 THEN 'no_higher_lows' END AS drop_reason FROM f)"""


def screened(t):
    return C.screen_features(t.bars).withColumn("drop_reason", C.drop_reason(0.0, band=(2.0, 90.0), max_runup=300.0, min_steps=1))


R.add("flt_04_screen_with_reasons", "symbol close~ off_high~ off_low~ runup~ drop_reason", screened, f"{SCREEN_SQL} SELECT * FROM r")
R.add("agg_33_drop_funnel", "drop_reason n#", lambda t: screened(t).groupBy("drop_reason").agg(F.count("*").alias("n")), f"{SCREEN_SQL} SELECT drop_reason, count(*) AS n FROM r GROUP BY 1")
# Universe filter matrix: which gates apply depends on the universe's row of a small table.
MATRIX = (("AFRICA", True, False), ("AMERICA", False, True), ("ASIA", True, True), ("EUROPE", False, False), ("MIDDLE EAST", True, True))


def matrix(t):
    config = t.spark.createDataFrame(MATRIX, "universe string, apply_fno boolean, apply_mcap boolean")
    s = t.table("supplier").select(F.col("s_suppkey").alias("symbol"), (F.col("s_suppkey") % 5 == 0).alias("in_fno"), F.col("s_acctbal").alias("mcap"))
    x = t.membership.join(s, "symbol").join(F.broadcast(config), "universe")
    return x.where((~F.col("apply_fno") | ~F.col("in_fno")) & (~F.col("apply_mcap") | F.col("mcap").between(1000, 9000)))


R.add("flt_05_universe_filter_matrix", "symbol universe", matrix, "WITH c(universe, apply_fno, apply_mcap) AS (VALUES " + ", ".join(f"('{u}', {a}, {b})" for u, a, b in MATRIX) + ") SELECT m.symbol, m.universe FROM membership m JOIN supplier ON m.symbol = s_suppkey JOIN c ON m.universe = c.universe WHERE (NOT apply_fno OR s_suppkey % 5 <> 0) AND (NOT apply_mcap OR s_acctbal BETWEEN 1000 AND 9000)")
WIDE = {**C.PARAMS, "near_low": -0.5, "near_high": 1.0, "max_base_range": 50.0, "min_score": 5.0}
RESISTANCE = """WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM bars),
f AS (SELECT *, (count(*) OVER a = 7 AND high = max(high) OVER a) OR (count(*) OVER b = 17 AND high = max(high) OVER b) AS p FROM r WHERE rn <= 252
 WINDOW a AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), b AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING)),
pv AS (SELECT symbol, date, high, row_number() OVER (PARTITION BY symbol ORDER BY high DESC, date) AS k FROM f WHERE p),
cl AS (SELECT symbol, k, high AS total, 1 AS n, 1 AS g FROM pv WHERE k = 1
 UNION ALL SELECT symbol, k + 1, CASE WHEN j THEN total + h ELSE h END, CASE WHEN j THEN n + 1 ELSE 1 END, CASE WHEN j THEN g ELSE g + 1 END
 FROM (SELECT cl.*, pv.high AS h, abs(pv.high - total/n)/(total/n) <= {band} AS j FROM cl JOIN pv ON pv.symbol = cl.symbol AND pv.k = cl.k + 1)),
lv AS (SELECT symbol, g, arg_max(total, k)/max(n) AS level, max(n) AS n FROM cl GROUP BY 1, 2),
nw AS (SELECT symbol, arg_max(close, date) AS close, max(date) AS last_date, count(*) AS days FROM bars GROUP BY 1),
nr AS (SELECT lv.symbol, lv.g, max(level) AS level, max(lv.n) AS n, max(close) AS close, max(last_date) AS last_date, count(*) AS touches, max(last_date - date) AS oldest, count(*) FILTER (last_date - date <= {base_max_days}) AS young, max(last_date - date) FILTER (last_date - date <= {base_max_days}) AS young_days
 FROM lv JOIN nw ON lv.symbol = nw.symbol AND days >= {base_min_days} + 20 JOIN pv ON pv.symbol = lv.symbol AND abs(pv.high - level)/level <= {band} GROUP BY 1, 2),
cd AS (SELECT *, (level - close)/close AS distance, CASE WHEN oldest <= {base_max_days} THEN oldest WHEN young >= {min_touches} THEN young_days END AS base_days FROM nr),
ok AS (SELECT * FROM cd WHERE n >= {min_touches} AND touches >= {min_touches} AND distance BETWEEN {near_low} AND {near_high} AND oldest >= {base_min_days} AND base_days IS NOT NULL),
bs AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY touches DESC, base_days DESC, abs(distance), level DESC) = 1),
cg AS (SELECT ok.* FROM ok JOIN bs ON ok.symbol = bs.symbol AND ok.level > bs.level*1.02 AND ok.touches >= greatest(2, floor(bs.touches*0.8)) AND ok.base_days >= floor(bs.base_days*0.8) QUALIFY row_number() OVER (PARTITION BY ok.symbol ORDER BY ok.level DESC) = 1),
res AS (SELECT symbol, level, touches, base_days, distance, CAST(last_date - CAST(base_days AS INTEGER) AS date) AS base_start FROM (SELECT * FROM cg UNION ALL SELECT * FROM bs WHERE symbol NOT IN (SELECT symbol FROM cg)))"""
R.add("pat_01_ud_01_resistance", "symbol level~ touches# base_days# distance~ base_start", lambda t: C.resistance(t.bars, WIDE), RESISTANCE.format(**WIDE) + " SELECT * FROM res")


def scored(t):
    """Score and plan of every symbol with a level, from the fold that the scan makes of its bars."""
    return C.breakout_scan(t.bars, t.bench, WIDE).where("level is not null")


R.add("pat_08_composite_score", "symbol score~ base_quality~ vcr~ vdu~ proximity~ trend~ rs~ high52~", scored)
R.add("pat_09_risk_plan", "symbol stop~ target~ rr~ risk_pct~", scored)
R.add("flt_06_breakout_scan", "symbol drop_reason hc_path score~ level~", lambda t: C.breakout_scan(t.bars, t.bench, WIDE))
R.add("agg_33_scan_funnel", "kind name n#", lambda t: C.scan_funnel(C.breakout_scan(t.bars, t.bench, WIDE), WIDE))


def signals(t):
    """A month-end breakout rule that SQL can state: at each date 60 sessions before a symbol's end, level = the highest high of the 60 sessions up to it."""
    x = t.bars.withColumn("level", F.max("high").over(S.last_rows(60)) * F.lit(0.7)).withColumn("rn", F.row_number().over(S.from_end())).where("rn in (3, 60, 200)")
    return x.select("symbol", F.col("date").alias("scan_date"), "level", F.col("close").alias("scan_close"), F.when(F.col("rn") == 60, "common").otherwise("main").alias("source"), F.col("volume").alias("score"))


SIGNALS = """n AS (SELECT *, max(high) OVER (PARTITION BY symbol ORDER BY date ROWS 59 PRECEDING)*0.7 AS level, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn, avg(volume) OVER (PARTITION BY symbol ORDER BY date ROWS 49 PRECEDING) AS v50 FROM bars),
sig AS (SELECT symbol, date AS scan_date, level, close AS scan_close, CASE WHEN rn = 60 THEN 'common' ELSE 'main' END AS source, volume AS score FROM n WHERE rn IN (3, 60, 200))"""
REVIEW = SIGNALS + """, cur AS (SELECT symbol, close AS now, v50 FROM n WHERE rn = 1),
post AS (SELECT s.symbol, s.scan_date, max(high) AS max_high, count(*) FILTER (b.close > s.level) AS days_above, bool_or(b.close > s.level AND b.volume > c.v50*1.3) AS vol, max(now) AS now FROM sig s JOIN n b ON b.symbol = s.symbol AND b.date > s.scan_date JOIN cur c ON c.symbol = s.symbol GROUP BY 1, 2),
rev AS (SELECT *, CASE WHEN now IS NULL THEN 'NO_DATA' WHEN days_above >= 2 AND vol THEN 'TRUE_BREAKOUT' WHEN days_above >= 2 THEN 'BREAKOUT_LOW_VOL' WHEN days_above >= 1 OR max_high > level THEN 'ATTEMPTED' WHEN change >= 0 THEN 'HOLDING' ELSE 'FALSE_SIGNAL' END AS status
 FROM (SELECT s.*, max_high, days_above, vol, now, (now/scan_close-1)*100 AS change, (max_high/scan_close-1)*100 AS max_gain FROM sig s LEFT JOIN post p ON s.symbol = p.symbol AND s.scan_date = p.scan_date))"""
R.add("flt_13_jn_12_signal_review", "symbol scan_date status days_above# change~ max_gain~", lambda t: C.review(signals(t), t.bars), f"WITH {REVIEW} SELECT * FROM rev")
R.add(
    "agg_10_hit_rates",
    "scan_date source n# valid# true_bo# low_vol# attempted# holding# false_sig# strict_rate~ loose_rate~",
    lambda t: C.hit_rates(C.review(signals(t), t.bars), "scan_date", "source"),
    f"""WITH {REVIEW}, c AS (SELECT scan_date, source, count(*) AS n, count(*) FILTER (status <> 'NO_DATA') AS valid, count(*) FILTER (status = 'TRUE_BREAKOUT') AS true_bo, count(*) FILTER (status = 'BREAKOUT_LOW_VOL') AS low_vol, count(*) FILTER (status = 'ATTEMPTED') AS attempted,
      count(*) FILTER (status = 'HOLDING') AS holding, count(*) FILTER (status = 'FALSE_SIGNAL') AS false_sig FROM rev GROUP BY 1, 2)
    SELECT *, CASE WHEN valid > 0 THEN 100.0 * true_bo / valid ELSE 0 END AS strict_rate, CASE WHEN valid > 0 THEN 100.0 * (true_bo + low_vol) / valid ELSE 0 END AS loose_rate FROM c""",
)
PATTERNS = {"high_conviction": "score > 30", "rs_rising_50d": "level > 1500", "pattern_vcp": "score > 45"}
R.add(
    "agg_11_outcome_comparison",
    "metric t_mean~ t_median~ t_n# f_mean~ f_median~ f_n# edge",
    lambda t: C.compare_outcomes(C.review(signals(t), t.bars).withColumns({c: F.expr(e) for c, e in PATTERNS.items()}), ["score", "level"], list(PATTERNS)),
    f"""WITH {REVIEW}, k AS (SELECT *, CASE WHEN status IN ('TRUE_BREAKOUT','BREAKOUT_LOW_VOL') THEN 't' WHEN status = 'FALSE_SIGNAL' THEN 'f' END AS kind FROM rev),
    u AS (SELECT kind, 'score' AS metric, score AS value FROM k WHERE kind IS NOT NULL UNION ALL SELECT kind, 'level', level FROM k WHERE kind IS NOT NULL),
    m AS (SELECT metric, avg(value) FILTER (kind='t') AS t_mean, median(value) FILTER (kind='t') AS t_median, count(value) FILTER (kind='t') AS t_n, avg(value) FILTER (kind='f') AS f_mean, median(value) FILTER (kind='f') AS f_median, count(value) FILTER (kind='f') AS f_n, '' AS edge FROM u GROUP BY 1),
    p AS ({' UNION ALL '.join(f"SELECT kind, '{c} (%)' AS metric, ({e})::INT AS hit FROM k WHERE kind IS NOT NULL" for c, e in PATTERNS.items())}),
    r AS (SELECT metric, coalesce(100.0 * avg(hit) FILTER (kind='t'), 0) AS t_mean, coalesce(sum(hit) FILTER (kind='t'), 0) AS t_n, coalesce(100.0 * avg(hit) FILTER (kind='f'), 0) AS f_mean, coalesce(sum(hit) FILTER (kind='f'), 0) AS f_n FROM p GROUP BY 1)
    SELECT * FROM m UNION ALL SELECT metric, t_mean, NULL, t_n, f_mean, NULL, f_n, CASE WHEN t_mean > f_mean + 10 THEN 'PREDICTIVE' WHEN f_mean > t_mean + 10 THEN 'ANTI-PREDICTIVE' ELSE '' END FROM r""",
)
R.add("top_04_best_and_worst", "side symbol scan_date value~", lambda t: (lambda r: r.orderBy(F.desc_nulls_last("max_gain"), "symbol", "scan_date").limit(10).select(F.lit("best").alias("side"), "symbol", "scan_date", F.col("max_gain").alias("value")).unionByName(r.orderBy(F.asc_nulls_last("change"), "symbol", "scan_date").limit(5).select(F.lit("worst").alias("side"), "symbol", "scan_date", F.col("change").alias("value"))))(C.review(signals(t), t.bars)), f"WITH {REVIEW} SELECT * FROM (SELECT 'best' AS side, symbol, scan_date, max_gain AS value FROM rev ORDER BY max_gain DESC NULLS LAST, symbol, scan_date LIMIT 10) UNION ALL SELECT * FROM (SELECT 'worst', symbol, scan_date, change FROM rev ORDER BY change NULLS LAST, symbol, scan_date LIMIT 5)")
R.add(
    "jn_06_missed_rallies",
    "symbol scan_date scan_close~ max_gain~ change~",
    lambda t: C.missed(t.bars.withColumn("rn", F.row_number().over(S.from_end())).where("rn in (2, 60, 100)").select("symbol", F.col("date").alias("scan_date")), signals(t), t.bars),
    f"""WITH {SIGNALS}, u AS (SELECT symbol, date AS scan_date FROM n WHERE rn IN (2, 60, 100)), l AS (SELECT u.* FROM u WHERE NOT EXISTS (SELECT 1 FROM sig s WHERE s.symbol = u.symbol AND s.scan_date = u.scan_date)),
    p AS (SELECT l.symbol, l.scan_date, count(*) AS k, max(b.high) AS top, arg_min(b.close, b.date) AS first_close, arg_max(b.close, b.date) AS last_close FROM l JOIN bars b ON b.symbol = l.symbol AND b.date > l.scan_date GROUP BY 1, 2)
    SELECT symbol, scan_date, first_close AS scan_close, (top/first_close - 1)*100 AS max_gain, (last_close/first_close - 1)*100 AS change FROM p WHERE k >= 2 AND (top/first_close - 1)*100 >= 10""",
)


def scan_parts(t):
    s = signals(t)
    return s.where("source = 'main'").select("symbol", "scan_date", "score", F.lit(True).alias("high_conviction")), s.where("source = 'common'").select("symbol", "scan_date", "level")


R.add("set_01_concat_differing_columns", "symbol scan_date score~ level~ high_conviction", lambda t: (lambda a, b: a.unionByName(b, allowMissingColumns=True))(*scan_parts(t)), f"WITH {SIGNALS} SELECT symbol, scan_date, score, NULL AS level, true AS high_conviction FROM sig WHERE source = 'main' UNION ALL SELECT symbol, scan_date, NULL, level, NULL FROM sig WHERE source = 'common'")
R.add("set_02_origin_labels", "symbol origin", lambda t: (lambda a, b: a.join(b, "symbol", "full").select("symbol", F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), "both").when(F.col("l").isNotNull(), "left").otherwise("right").alias("origin")))(t.membership.where("symbol % 2 = 0").select("symbol", F.lit(1).alias("l")), t.membership.where("symbol % 3 = 0").select("symbol", F.lit(1).alias("r"))), "SELECT symbol, CASE WHEN symbol % 6 = 0 THEN 'both' WHEN symbol % 2 = 0 THEN 'left' ELSE 'right' END AS origin FROM membership WHERE symbol % 2 = 0 OR symbol % 3 = 0")
R.add("top_03_conviction_then_score", "symbol scan_date score~ place#", lambda t: signals(t).orderBy(F.desc(F.col("source") == "main"), F.desc("score"), "symbol", "scan_date").limit(10).withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.col("source") == "main"), F.desc("score"), "symbol", "scan_date"))), f"WITH {SIGNALS} SELECT *, row_number() OVER (ORDER BY source DESC, score DESC, symbol, scan_date) AS place FROM sig QUALIFY place <= 10")
# Listing-day joins: a symbol lists three days before its first bar on or after the 10th of January 1995.
LIST = lambda t: t.bars.groupBy("symbol").agg(F.date_sub(F.min("date"), F.col("symbol").cast("int") % 7).alias("listing"), F.min_by("open", "date").alias("issue"))
LIST_SQL = "SELECT symbol, CAST(min(date) - CAST(symbol % 7 AS INTEGER) AS date) AS listing, arg_min(open, date) AS issue FROM bars GROUP BY symbol"
R.add("jn_10_first_bar_after_listing", "symbol listing close~", lambda t: LIST(t).join(t.bars.select("symbol", "date", "close"), "symbol").where("date between listing and date_add(listing, 4)").groupBy("symbol", "listing").agg(F.min_by("close", "date").alias("close")), f"SELECT l.symbol, listing, arg_min(close, date) AS close FROM ({LIST_SQL}) l JOIN bars b ON l.symbol = b.symbol AND date BETWEEN listing AND listing + 4 GROUP BY 1, 2")
R.add("flt_17_listing_label", "symbol gain~ label", lambda t: t.bars.groupBy("symbol").agg(((ratio(F.min_by("close", "date"), F.min_by("open", "date")) - 1) * 100).alias("gain")).withColumn("label", F.when(F.col("gain") > 0.5, "Positive").when(F.col("gain") < -0.5, "Negative").otherwise("Flat")), "SELECT *, CASE WHEN gain > 0.5 THEN 'Positive' WHEN gain < -0.5 THEN 'Negative' ELSE 'Flat' END AS label FROM (SELECT symbol, (arg_min(close, date)/arg_min(open, date)-1)*100 AS gain FROM bars GROUP BY 1)")
R.add("jn_19_common_over_periods", "symbol p3~ p6~ p12~ worst~", lambda t: (lambda x: x.groupBy("symbol").pivot("label", ["p3", "p6", "p12"]).agg(F.first("off")).where("p3 is not null and p6 is not null and p12 is not null").withColumn("worst", F.least("p3", "p6", "p12")))(
    (lambda b: b.select("symbol", F.explode(F.array(*[F.struct(F.lit(f"p{m}").alias("label"), F.when(F.col(f"off{n}") <= -2, F.col(f"off{n}")).alias("off")) for m, n in ((3, 63), (6, 126), (12, 252))])).alias("s")).select("symbol", "s.*").where("off is not null"))(
        t.bars.select("symbol", "date", *[((ratio("close", F.max("high").over(S.last_rows(n))) - 1) * 100).alias(f"off{n}") for n in (63, 126, 252)]).withColumn("rn", F.row_number().over(S.from_end())).where("rn = 1"))),
    "SELECT * FROM (SELECT symbol, p3, p6, p12, least(p3, p6, p12) AS worst FROM (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn, " + ", ".join(f"(close/max(high) OVER (PARTITION BY symbol ORDER BY date ROWS {n - 1} PRECEDING)-1)*100 AS p{m}" for m, n in ((3, 63), (6, 126), (12, 252))) + " FROM bars) WHERE rn = 1) WHERE p3 <= -2 AND p6 <= -2 AND p12 <= -2")
R.add("flt_19_flt_20_market_cap_crore", "symbol fy mcap_k~", lambda t: t.fundamentals.join(t.last_close, "symbol").select("symbol", "fy", (F.coalesce(F.when(F.col("fy") % 2 == 0, F.col("market_cap")), F.col("shares_outstanding") * F.col("last_close")) / 1e3).alias("mcap_k")), "SELECT f.symbol, fy, coalesce(CASE WHEN fy % 2 = 0 THEN market_cap END, shares_outstanding*last_close)/1e3 AS mcap_k FROM fundamentals f JOIN last_closes l ON f.symbol = l.symbol")
R.add("src_27_watchlist_lines", "line", lambda t: t.membership.select(F.regexp_replace(F.concat(F.col("symbol").cast("string"), F.when(F.col("symbol") % 2 == 0, ".NS").otherwise(".BO")), r"^(.*)\.NS$", "NSE:$1").alias("line")).select(F.regexp_replace("line", r"^(.*)\.BO$", "BSE:$1").alias("line")), "SELECT CASE WHEN symbol % 2 = 0 THEN 'NSE:' ELSE 'BSE:' END || symbol AS line FROM membership")
QUERIES, ORACLE = R.queries, R.oracle
