"""Queries of the accounting scores. Their SQL is written out by hand, here and in accounting_sql.py; `duck` serves the wide row of the rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import ratio
from ..operators import flows as O
from ..operators import fundamentals as A
from ..operators import portfolio as P
from ..operators import series as S
from ..operators import text as T
from ..sources import fixtures
from ..sources.store import written
from .accounting_sql import ROWS, SPANS
from .portfolio_queries import ORACLE as PORTFOLIO_SQL
from .registry import Registry
from .series_queries import ORACLE as SERIES_SQL
from .text_queries import ORACLE as TEXT_SQL
from .text_queries import AGENCY_SQL, q

R = Registry()


def duck(e: str) -> str:
    """div(a, b) as (a) / nullif(b, 0), wherever it stands."""
    while (at := e.find("div(")) >= 0:
        depth, comma, i = 0, -1, at + 4
        while depth or e[i] != ")":
            depth += {"(": 1, ")": -1}.get(e[i], 0)
            if e[i] == "," and not depth and comma < 0:
                comma = i
            i += 1
        e = f"{e[:at]}(({e[at + 4 : comma]}) / nullif({e[comma + 1 : i]}, 0)){e[i + 1 :]}"
    return e


LAGS = ", ".join(f"lag({c}) OVER w AS {c}_1" for c in ("fy", *A.ITEMS))
fixtures.SQL.setdefault("annual_rows", f"SELECT *, {LAGS}, row_number() OVER (PARTITION BY symbol ORDER BY fy DESC) AS rn FROM fundamentals WINDOW w AS (PARTITION BY symbol ORDER BY fy)")


def nested(source: str, columns) -> str:
    for name, e in columns:
        source = f"SELECT *, {duck(e)} AS {name} FROM ({source})"
    return source


#: Scores by row that compare ratios of two multiples of one sum.
LAST_BIT = ("fun_03_piotroski_f",)
for name, (spec, sql) in ROWS.items():
    R.add(name, f"symbol fy {spec}", lambda t, name=name: A.row_score(t.fundamentals_in_order if name in LAST_BIT else t.fundamentals, name), sql)
for name, (spec, sql) in SPANS.items():
    R.add(name, f"symbol {spec}", lambda t, name=name: A.span_score(t.fundamentals, name), sql)

# Scores whose SQL others below use.
CAGR = "CASE WHEN {n} > 1 AND {a} > 0 AND {b} > 0 THEN (pow({a} / {b}, 1.0 / ({n} - 1)) - 1) * 100 END"
HAND_SQL = {
    "fun_09_tax_outlier": """WITH t AS (SELECT symbol, rn, fy, tax / nullif(pretax_income, 0) * 100 AS rate FROM annual_rows WHERE rn <= 4),
m AS (SELECT *, count(rate) OVER (PARTITION BY symbol) AS n, avg(rate) OVER (PARTITION BY symbol) AS mean FROM t)
SELECT symbol, max(n) AS n, max(mean) AS mean, arg_min(fy, rn) FILTER (n >= 3 AND abs(rate - mean) > 10) AS outlier_year, coalesce(bool_or(n >= 3 AND abs(rate - mean) > 10), false) AS outlier FROM m GROUP BY 1""",
    "fun_22_revenue_margin": f"""WITH s AS (SELECT symbol, list(revenue ORDER BY rn) AS r, list(net_income ORDER BY rn) AS p, list(ebitda / nullif(revenue, 0) * 100 ORDER BY rn) FILTER (ebitda / nullif(revenue, 0) IS NOT NULL) AS e,
  count(*) AS n, count(gross_profit / nullif(revenue, 0)) AS ng, stddev_pop(gross_profit / nullif(revenue, 0) * 100) AS gm_sd FROM annual_rows WHERE rn <= 5 GROUP BY 1)
SELECT symbol, n, ng, gm_sd, p[1] / nullif(r[1], 0) * 100 AS pat_margin, {CAGR.format(n='least(n, 4)', a='r[1]', b='r[least(n, 4)]')} AS revenue_cagr, CASE WHEN n >= 4 THEN {CAGR.format(n='n', a='r[1]', b='r[n]')} END AS revenue_cagr_5y, {CAGR.format(n='least(n, 4)', a='p[1]', b='p[least(n, 4)]')} AS pat_cagr,
  CASE WHEN len(e) < 3 THEN 'stable' WHEN e[1] > e[len(e)] + 2 THEN 'expanding' WHEN e[1] < e[len(e)] - 2 THEN 'contracting' ELSE 'stable' END AS trend FROM s""",
    "fun_24_earnings_quality": """WITH s AS (SELECT *, operating_cf / nullif(net_income, 0) AS backing, (net_income - operating_cf) / CASE WHEN total_assets_1 IS NULL THEN total_assets ELSE (total_assets + total_assets_1) / 2 END AS accrual FROM annual_rows WHERE rn <= 4)
SELECT symbol, coalesce(avg(backing), 0) AS avg_cfo_pat, coalesce(avg(accrual), 0) AS avg_accrual,
  max(((receivables - receivables_1) / nullif(abs(receivables_1), 0) - (revenue - revenue_1) / nullif(abs(revenue_1), 0)) * 100) FILTER (rn = 1) AS divergence, max(coalesce(abs(capex), 0) / nullif(abs(depreciation), 0)) FILTER (rn = 1) AS capex_dep FROM s GROUP BY 1""",
    "fun_26_dividends": """SELECT symbol, count(*) AS n, count(*) FILTER (dividends_paid <> 0) AS paid_years, avg(CASE WHEN net_income > 0 THEN coalesce(abs(dividends_paid), 0) / net_income * 100 ELSE 0 END) AS avg_payout,
  count(*) FILTER (dividends_paid <> 0) >= count(*) - 1 AS consistent FROM annual_rows WHERE rn <= 5 GROUP BY 1""",
    "fun_31_capex_cycle": """WITH s AS (SELECT symbol, list(revenue / total_assets ORDER BY rn) FILTER (revenue / nullif(total_assets, 0) IS NOT NULL) AS a, max(CASE WHEN revenue > 0 THEN coalesce(abs(capex), 0) / revenue * 100 ELSE 0 END) FILTER (rn = 1) AS intensity,
  max(coalesce(abs(capex), 0)) FILTER (rn = 1) AS spent, max(coalesce(abs(depreciation), 0)) FILTER (rn = 1) AS maintenance FROM annual_rows WHERE rn <= 5 GROUP BY 1)
SELECT symbol, intensity, maintenance, greatest(0, spent - maintenance) AS growth_capex, CASE WHEN spent > 0 THEN greatest(0, spent - maintenance) / spent * 100 ELSE 0 END AS growth_capex_pct,
  CASE WHEN len(a) < 3 THEN 'stable' WHEN a[1] > a[len(a)] + 0.1 THEN 'improving' WHEN a[1] < a[len(a)] - 0.1 THEN 'deteriorating' ELSE 'stable' END AS turnover FROM s""",
    "fun_32_tax": """WITH s AS (SELECT symbol, rn, CASE WHEN pretax_income > 0 THEN tax / pretax_income END AS rate FROM annual_rows WHERE rn <= 5),
m AS (SELECT symbol, coalesce(avg(rate) FILTER (rate > 0 AND rate < 0.5), 0) * 100 AS avg_rate, coalesce(max(rate) FILTER (rn = 1), 0) * 100 AS latest FROM s GROUP BY 1)
SELECT *, 25.2 - avg_rate AS gap, 25.2 - avg_rate > 5 AS benefit FROM m""",
}
HAND_SPEC = {
    "fun_09_tax_outlier": "n# mean~ outlier_year outlier", "fun_22_revenue_margin": "n# ng# gm_sd~ pat_margin~ revenue_cagr~ revenue_cagr_5y~ pat_cagr~ trend", "fun_24_earnings_quality": "avg_cfo_pat~ avg_accrual~ divergence~ capex_dep~",
    "fun_26_dividends": "n# paid_years# avg_payout~ consistent", "fun_31_capex_cycle": "intensity~ maintenance~ growth_capex~ growth_capex_pct~ turnover", "fun_32_tax": "avg_rate~ latest~ gap~ benefit",
}
for name in HAND_SQL:
    R.add(name, f"symbol {HAND_SPEC[name]}", lambda t, name=name: A.span_score(t.fundamentals, name), HAND_SQL[name])

QUARTER_ROWS = "qr AS (SELECT *, lag(revenue) OVER w AS before, row_number() OVER (PARTITION BY symbol ORDER BY quarter_end DESC) AS rn FROM quarters WINDOW w AS (PARTITION BY symbol ORDER BY quarter_end))"
MOMENTUM_SQL = f"""WITH {QUARTER_ROWS}, s AS (SELECT symbol, count(*) AS n, list(revenue ORDER BY rn) AS r, list(net_income ORDER BY rn) AS p, list((revenue - before) / nullif(abs(before), 0) * 100 ORDER BY rn) AS q, list(ebitda / nullif(revenue, 0) * 100 ORDER BY rn) AS e FROM qr WHERE rn <= 8 GROUP BY 1)
SELECT symbol, n, q[1] AS q0, q[2] AS q1, e[1] AS ebitda_margin, (r[1] - r[5]) / nullif(abs(r[5]), 0) * 100 AS revenue_yoy, (p[1] - p[5]) / nullif(abs(p[5]), 0) * 100 AS profit_yoy,
  CASE WHEN q[1] > q[2] + 3 THEN 'accelerating' WHEN q[1] < q[2] - 3 THEN 'decelerating' ELSE 'stable' END AS acceleration FROM s"""
R.add("win_33_momentum", "symbol n# q0~ q1~ ebitda_margin~ revenue_yoy~ profit_yoy~ acceleration", lambda t: A.quarter_score(t.quarters, "win_33_momentum"), MOMENTUM_SQL)
R.add(
    "fun_10_period_drops",
    "symbol revenue_change~ income_change~ revenue_drop income_drop",
    lambda t: A.quarter_score(t.quarters, "fun_10_quarter_drops"),
    """WITH s AS (SELECT symbol, row_number() OVER w AS rn, CASE WHEN lead(revenue) OVER w > 0 THEN (revenue / lead(revenue) OVER w - 1) * 100 END AS rc, CASE WHEN lead(net_income) OVER w > 0 THEN (net_income / lead(net_income) OVER w - 1) * 100 END AS ic
      FROM quarters WINDOW w AS (PARTITION BY symbol ORDER BY quarter_end DESC))
    SELECT symbol, rc AS revenue_change, ic AS income_change, coalesce(rc < -20, false) AS revenue_drop, coalesce(ic < -30, false) AS income_drop FROM s WHERE rn = 1""",
)
R.add(
    "fun_10_newest_quarter_known",
    "symbol fy quarter_end revenue~ q_revenue~ q_net_income~",
    lambda t: A.newest_quarter_known(t.fundamentals.select("symbol", "fy", "revenue", F.make_date("fy", F.lit(11), F.lit(15)).alias("known_on")), t.quarters),
    "SELECT f.symbol, fy, q.quarter_end, f.revenue, q.revenue AS q_revenue, q.net_income AS q_net_income FROM (SELECT *, make_date(fy, 11, 15) AS known_on FROM fundamentals) f ASOF LEFT JOIN quarters q ON f.symbol = q.symbol AND f.known_on >= q.quarter_end",
)

CAPITAL_SQL = """y AS (SELECT symbol, rn, operating_inc, capex, depreciation, total_assets - current_liabilities - coalesce(cash, 0) AS ic, operating_inc * (1 - CASE WHEN tax / nullif(pretax_income, 0) IS NULL THEN 0.25 ELSE least(greatest(tax / pretax_income, 0.15), 0.35) END) AS nopat FROM annual_rows WHERE rn <= 5),
z AS (SELECT *, nopat / nullif(ic, 0) * 100 AS roce, (operating_inc - lead(operating_inc) OVER w) / nullif(ic - lead(ic) OVER w, 0) * 100 AS inc FROM y WINDOW w AS (PARTITION BY symbol ORDER BY rn)),
ca AS (SELECT symbol, coalesce(avg(roce), 0) AS avg_roce, CASE WHEN count(*) > 1 THEN coalesce(avg(inc), 0) END AS incremental_roce, count(*) FILTER (roce > 15) AS high_years,
  max(CASE WHEN operating_inc > 0 THEN (coalesce(abs(capex), 0) - coalesce(abs(depreciation), 0)) / (0.75 * operating_inc) * 100 ELSE 0 END) FILTER (rn = 1) AS reinvestment FROM z GROUP BY 1)"""
MOAT_SQL = f"""SELECT *, CASE WHEN moat >= 8 THEN 'WIDE MOAT' WHEN moat >= 6 THEN 'NARROW MOAT' WHEN moat >= 4 THEN 'EMERGING MOAT' ELSE 'NO MOAT' END AS kind FROM (SELECT a.symbol, revenue_cagr, CASE WHEN high_years >= 4 THEN 2 WHEN high_years >= 2 THEN 1 ELSE 0 END + CASE WHEN ng < 3 THEN 0 WHEN gm_sd < 3 THEN 2 WHEN gm_sd < 6 THEN 1 ELSE 0 END
 + CASE WHEN revenue_cagr > 15 AND trend = 'expanding' THEN 2 WHEN revenue_cagr > 10 THEN 1 ELSE 0 END + CASE WHEN capex_dep < 1.5 THEN 2 WHEN capex_dep < 2.5 THEN 1 ELSE 0 END + CASE WHEN avg_cfo_pat > 0.9 THEN 2 WHEN avg_cfo_pat > 0.7 THEN 1 ELSE 0 END AS moat
 FROM (WITH {CAPITAL_SQL} SELECT * FROM ca) a JOIN ({HAND_SQL['fun_22_revenue_margin']}) r ON a.symbol = r.symbol JOIN ({HAND_SQL['fun_24_earnings_quality']}) q ON a.symbol = q.symbol)"""
R.add("fun_27_moat", "symbol moat# kind", lambda t: A.moat(t.fundamentals), MOAT_SQL)

VALUE = lambda cash, g, w: " + ".join([f"{cash}*pow(1+{g},{k})/pow(1+{w},{k})" for k in range(1, 6)] + [f"{cash}*pow(1+{g},5)*{'*'.join(f'(1+{g}-({g}-0.05)*{j}/5.0)' for j in range(1, k + 1))}/pow(1+{w},{5 + k})" for k in range(1, 6)] + [f"{cash}*pow(1+{g},5)*{'*'.join(f'(1+{g}-({g}-0.05)*{j}/5.0)' for j in range(1, 6))}*1.05/({w}-0.05)/pow(1+{w},10)"])
DCF_SQL = f"""WITH a AS (SELECT symbol, count(fcf) AS n, count(*) AS years, arg_min(fcf, rn) AS fcf0, arg_max(fcf, rn) AS fcf9, avg(fcf) FILTER (fcf > 0) AS mean_pos, arg_min(revenue, rn) AS r0, arg_max(revenue, rn) FILTER (rn <= 4) AS r3, {', '.join(f'arg_min({c}, rn) AS {c}' for c in ('total_debt', 'interest_exp', 'tax', 'pretax_income', 'cash', 'shares_outstanding', 'market_cap'))} FROM annual_rows WHERE rn <= 5 GROUP BY 1),
b AS (SELECT *, CASE WHEN fcf0 > 0 THEN fcf0 ELSE mean_pos END AS start_, CASE WHEN n >= 3 AND fcf9 > 0 AND fcf0 > 0 THEN pow(fcf0/fcf9, 1.0/(n-1)) - 1 ELSE coalesce(CASE WHEN r0 >= 0 AND r3 > 0 THEN pow(r0/r3, 1.0/(least(years, 4) - 1)) - 1 END, 0.10) END AS cagr FROM a WHERE n >= 2),
c AS (SELECT *, least(greatest(cagr, 0.05), 0.35) AS g, greatest(market_cap/(market_cap+total_debt)*(0.07+0.06) + total_debt/(market_cap+total_debt)*CASE WHEN total_debt > 0 THEN coalesce(abs(interest_exp)/total_debt, 0.08) ELSE 0.08 END*(1-least(greatest(coalesce(tax/nullif(pretax_income,0), 0.25), 0.15), 0.35)), 0.08) AS wacc FROM b WHERE start_ > 0),
d AS (SELECT *, {VALUE('start_', 'g', 'wacc')} AS ev FROM c),
v AS (SELECT *, (ev - total_debt + cash)/shares_outstanding AS per_share, market_cap/shares_outstanding AS price, CASE WHEN ev - total_debt + cash > 0 THEN ((ev-total_debt+cash)/shares_outstanding - market_cap/shares_outstanding)/((ev-total_debt+cash)/shares_outstanding)*100 ELSE 0 END AS margin_of_safety FROM d)"""
R.add("fun_33_dcf", "symbol cagr~ g~ wacc~ margin_of_safety~", lambda t: A.dcf(t.fundamentals), f"{DCF_SQL} SELECT * FROM v")
R.add("fun_21_capital_allocation", "symbol avg_roce~ incremental_roce~ reinvestment~ high_years# spread~", lambda t: A.capital_allocation(t.fundamentals), f"{DCF_SQL}, {CAPITAL_SQL} SELECT ca.*, avg_roce - coalesce(wacc * 100, 12) AS spread FROM ca LEFT JOIN v ON ca.symbol = v.symbol")
R.add(
    "fun_30_graham_magic",
    "symbol graham~ upside~ earnings_yield~ roic~ peg~",
    lambda t: A.graham(t.fundamentals),
    f"""WITH x AS (SELECT *, market_cap / shares_outstanding AS price, equity / shares_outstanding AS book, market_cap + total_debt - cash AS ev, total_assets - current_liabilities - cash AS capital FROM annual_rows WHERE rn = 1),
    g AS (SELECT *, CASE WHEN eps > 0 AND book > 0 THEN sqrt(22.5 * eps * book) ELSE 0 END AS graham FROM x)
    SELECT g.symbol, graham, CASE WHEN price > 0 AND graham > 0 THEN (graham / price - 1) * 100 ELSE 0 END AS upside, CASE WHEN ev > 0 THEN operating_inc / ev * 100 ELSE 0 END AS earnings_yield, CASE WHEN capital > 0 THEN operating_inc * 0.75 / capital * 100 ELSE 0 END AS roic,
      CASE WHEN pat_cagr > 0 THEN market_cap / net_income / pat_cagr END AS peg FROM g JOIN ({HAND_SQL['fun_22_revenue_margin']}) r ON g.symbol = r.symbol""",
)
SCENARIOS = (("low", 0.8), ("base", 1.0), ("high", 1.3))
R.add("fun_33_dcf_scenarios", "symbol scenario wacc~ margin_of_safety~", lambda t: A.dcf(t.fundamentals, t.spark.createDataFrame(SCENARIOS, "scenario string, beta double")),
      DCF_SQL.replace("FROM b WHERE start_ > 0", "FROM b CROSS JOIN (VALUES ('low', 0.8), ('base', 1.0), ('high', 1.3)) s(scenario, beta) WHERE start_ > 0").replace("(0.07+0.06)", "(0.07+beta*0.06)") + " SELECT * FROM v")
REVERSE_SQL = DCF_SQL.replace("WITH a AS", "WITH RECURSIVE a AS") + f""", h AS (SELECT symbol, start_, wacc, cagr, margin_of_safety, price*shares_outstanding + total_debt - cash AS market, CAST(-0.10 AS DOUBLE) AS lo, CAST(0.60 AS DOUBLE) AS hi, 0 AS k FROM v
 UNION ALL SELECT symbol, start_, wacc, cagr, margin_of_safety, market, CASE WHEN pv < market THEN mid ELSE lo END, CASE WHEN pv < market THEN hi ELSE mid END, k + 1 FROM (SELECT *, {VALUE('start_', 'mid', 'wacc')} AS pv FROM (SELECT *, (lo+hi)/2 AS mid FROM h WHERE k < 50))),
rv AS (SELECT symbol, (lo+hi)/2 AS implied, (lo+hi)/2 - cagr AS premium, margin_of_safety FROM h WHERE k = 50)"""
R.add("fun_34_reverse_dcf", "symbol implied~ premium~", lambda t: A.reverse_dcf(A.dcf(t.fundamentals)), f"{REVERSE_SQL} SELECT * FROM rv")

NEWEST = "QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY fy DESC) = 1"
TECH_SQL = " UNION ALL ".join(
    [f"SELECT symbol, '{k}' AS technique, CAST(score AS DOUBLE) AS score FROM ({ROWS[n][1]}) {NEWEST}" for k, n in A.ROW_TECHNIQUES.items()] + [f"SELECT symbol, '{k}', CAST(score AS DOUBLE) FROM ({SPANS[n][1]})" for k, n in A.SPAN_TECHNIQUES.items()]
)
DIGITS_SQL = """SELECT symbol, CASE WHEN chi_square > 20.09 THEN 2.0 WHEN chi_square > 15.507 THEN 5.0 ELSE 9.0 END AS score FROM (
  SELECT symbol, sum(pow(coalesce(n, 0) - log10(1 + 1.0/d)*total, 2)/(log10(1 + 1.0/d)*total)) AS chi_square FROM (
    SELECT t.symbol, total, dd.d, n FROM (SELECT symbol, count(*) AS total FROM ({v}) GROUP BY 1 HAVING count(*) >= 50) t CROSS JOIN (SELECT unnest(range(1, 10)) AS d) dd
    LEFT JOIN (SELECT symbol, d, count(*) AS n FROM ({v}) GROUP BY 1, 2) c ON c.symbol = t.symbol AND c.d = dd.d) GROUP BY symbol)""".replace(
    "{v}", "SELECT symbol, CAST(regexp_extract(printf('%.10e', abs(value)), '[1-9]') AS INT) AS d FROM (" + " UNION ALL ".join(f"SELECT symbol, CAST({c} AS DOUBLE) AS value FROM fundamentals" for c in A.ITEMS) + ") WHERE value <> 0"
)
TECH_SQL += f" UNION ALL SELECT symbol, 'benford', score FROM ({DIGITS_SQL})"
PROMOTERS = lambda t: t.stakes.select("ticker", "as_of", (F.col("pct") * 3).alias("promoter_pct"), F.when(F.col("ticker") % 4 != 0, F.greatest(F.lit(0.0), F.pmod(F.col("pct") * 7, F.lit(90.0)) - 15)).alias("pledge_pct"))
LEFT_OUT = {n: ["symbol", "fy", *(c for c in ("verdict", "score") if c in ROWS[n][0].replace("~", "").split())] for n in A.RULE_ROWS}
FLAG_ROWS = f"""SELECT a.*, {', '.join(f"{n}.* EXCLUDE ({', '.join(c)})" for n, c in LEFT_OUT.items())} FROM annual_rows a {' '.join(f"JOIN ({ROWS[n][1]}) {n} ON a.symbol = {n}.symbol AND a.fy = {n}.fy" for n in A.RULE_ROWS)} WHERE rn = 1"""
#: The years' rows that the rules look at, written out.
SPANS_SQL = """WITH a AS (SELECT *, div_(gross_profit, revenue)*100 AS gm, div_(operating_inc, revenue)*100 AS om, div_(net_income, equity)*100 AS roe, div_(tax, pretax_income)*100 AS rate FROM annual_rows WHERE rn <= 4),
o AS (SELECT symbol, list(gm ORDER BY rn) AS g, list(om ORDER BY rn) AS o, list(roe ORDER BY rn) AS e, list(revenue ORDER BY rn) AS r, list(net_income ORDER BY rn) AS p, count(*) AS n, count(*) FILTER (operating_cf < 0) AS neg_cfo, count(*) FILTER (fcf < 0) AS neg_fcf,
  count(*) FILTER (net_income > 0 AND operating_cf < net_income) AS below, arg_min(div_(net_income - operating_cf, total_assets), rn) AS accrual, count(*) FILTER (net_income < 0) AS losses, count(*) FILTER (depreciation > 0 AND abs(capex) < depreciation*0.8) AS under,
  sum(abs(capex)) AS cx, sum(depreciation) AS dp, count(capex + depreciation) AS pairs, count(net_income) AS k, stddev_pop(net_income) AS sd, avg(net_income) AS mean FROM a GROUP BY 1),
d AS (SELECT symbol, avg(abs(dol)) FILTER (abs(dol) < 50) AS dol FROM (SELECT symbol, div_(div_(ebit - ebit_1, abs(ebit_1))*100, div_(revenue - revenue_1, abs(revenue_1))*100) AS dol FROM annual_rows WHERE rn <= 3) GROUP BY 1),
t AS (SELECT symbol, bool_or(n >= 3 AND abs(rate - mean) > 10) AS odd FROM (SELECT symbol, rate, count(rate) OVER w AS n, avg(rate) OVER w AS mean FROM a WINDOW w AS (PARTITION BY symbol)) GROUP BY 1)
SELECT o.symbol, coalesce(n >= 3 AND g[1] < g[n] - 5, false) AS mt_gross_falling, coalesce(n >= 3 AND g[1] > g[n] + 2, false) AS mt_gross_rising, coalesce(n >= 3 AND o[1] < o[n] - 3, false) AS mt_operating_falling,
  neg_cfo AS cf_neg_cfo, neg_fcf AS cf_neg_fcf, below AS cf_cfo_lt_ni, accrual AS cf_accrual, CASE WHEN n >= 2 AND r[n] > 0 THEN CASE WHEN r[1] > 0 THEN (pow(r[1]/r[n], 1.0/(n - 1)) - 1)*100 ELSE -100 END END AS gr_revenue_cagr,
  CASE WHEN n >= 2 AND p[n] > 0 THEN CASE WHEN p[1] > 0 THEN (pow(p[1]/p[n], 1.0/(n - 1)) - 1)*100 ELSE -100 END END AS gr_profit_cagr, losses AS ly_loss_years, under AS ly_under_investing, pairs AS ly_pairs, div_(cx, dp) AS ly_capex_dep,
  CASE WHEN k >= 3 THEN div_(sd, abs(mean))*100 END AS ev_cv, dol AS ol_avg_dol, coalesce(odd, false) AS tx_outlier, n AS re_n, e[1] AS re_now, e[n] AS re_old FROM o LEFT JOIN d ON o.symbol = d.symbol LEFT JOIN t ON o.symbol = t.symbol"""
SPANS_SQL = duck(SPANS_SQL.replace("div_(", "div("))
DROPS_SQL = """SELECT symbol, coalesce((r[1]/r[2] - 1)*100 < -20 AND r[2] > 0, false) AS revenue_drop, coalesce((p[1]/p[2] - 1)*100 < -30 AND p[2] > 0, false) AS income_drop
FROM (SELECT symbol, list(revenue ORDER BY quarter_end DESC) AS r, list(net_income ORDER BY quarter_end DESC) AS p FROM quarters GROUP BY 1)"""
WIDE_SQL = f"""SELECT fr.*, sp.* EXCLUDE (symbol), CASE dg.score WHEN 9 THEN 'PASS' WHEN 5 THEN 'MARGINAL' WHEN 2 THEN 'FAIL' END AS conformity, revenue_drop, income_drop, s_acctbal < 0 AS listed
FROM ({FLAG_ROWS}) fr JOIN ({SPANS_SQL}) sp ON fr.symbol = sp.symbol LEFT JOIN ({DIGITS_SQL}) dg ON fr.symbol = dg.symbol LEFT JOIN ({DROPS_SQL}) dr ON fr.symbol = dr.symbol LEFT JOIN supplier ON fr.symbol = s_suppkey"""
RATED_SQL = f"SELECT b.*, down AS downgraded FROM ({TEXT_SQL['agg_25_best_ratings']}) b JOIN (SELECT symbol, {AGENCY_SQL} AS agency, bool_or(contains(lower(text), 'downgrad')) AS down FROM filings GROUP BY 1, 2) d ON b.symbol = d.symbol AND b.agency = d.agency"
PROMOTER_SQL = """SELECT symbol, split_part(f, ':', 1) AS rule, split_part(f, ':', 2) AS severity FROM (
  SELECT symbol, unnest([CASE WHEN p < 25 THEN 'low_promoter:major' WHEN p > 70 THEN 'high_promoter:green' END, CASE WHEN pledge > 50 THEN 'pledge_very_high:critical' WHEN pledge > 20 THEN 'pledge_high:major' WHEN pledge > 0 THEN 'pledge:minor' WHEN pledge = 0 THEN 'no_pledge:green' END,
    CASE WHEN change < -3 THEN 'promoter_sold:major' WHEN change > 2 THEN 'promoter_bought:green' END]) AS f FROM (
    SELECT ticker AS symbol, pct * 3 AS p, pct * 3 - lag(pct * 3) OVER (PARTITION BY ticker ORDER BY as_of) AS change, CASE WHEN ticker % 4 <> 0 THEN greatest(0, (pct * 7) % 90 - 15) END AS pledge, row_number() OVER (PARTITION BY ticker ORDER BY as_of DESC) AS rn FROM stakes) WHERE rn = 1
    AND symbol IN (SELECT symbol FROM fundamentals)) WHERE f IS NOT NULL"""
FLAG_SQL = " UNION ALL ".join(f"SELECT symbol, '{n}' AS rule, '{s}' AS severity FROM wd WHERE {duck(c)}" for n, s, c in A.FLAGS)
FLAG_SQL += f" UNION ALL {PROMOTER_SQL} UNION ALL SELECT symbol, CASE WHEN rank >= 9 THEN 'rating_high' WHEN rank >= 7 THEN 'rating_good' WHEN rank >= 5 THEN 'rating_medium' ELSE 'rating_junk' END, CASE WHEN rank >= 7 THEN 'green' WHEN rank >= 5 THEN 'minor' ELSE 'critical' END FROM rt WHERE rank > 0"
FLAG_SQL += " UNION ALL SELECT symbol, 'negative_outlook', 'major' FROM rt GROUP BY 1 HAVING bool_or(negative) UNION ALL SELECT symbol, 'downgraded', 'major' FROM rt GROUP BY 1 HAVING bool_or(downgraded)"
FLAG_WITH = f"wd AS ({WIDE_SQL}), rt AS (SELECT * FROM ({RATED_SQL}) WHERE symbol IN (SELECT symbol FROM fundamentals)), fl AS ({FLAG_SQL})"


def raised_flags(t):
    listed = t.table("supplier").select(F.col("s_suppkey").alias("symbol"), (F.col("s_acctbal") < 0).alias("listed"))
    return A.flags(t.fundamentals_in_order, t.quarters, listed, PROMOTERS(t), T.best_ratings(t.filings))


OVERALL_SQL = f"""WITH {FLAG_WITH}, te AS ({TECH_SQL}), w(technique, w) AS (VALUES {', '.join(f"('{k}', {v})" for k, v in A.WEIGHTS.items())}),
ba AS (SELECT symbol, sum(score*w)/sum(w)*10 AS base FROM te JOIN w ON te.technique = w.technique WHERE score IS NOT NULL GROUP BY 1),
pe AS (SELECT symbol, sum(CASE severity WHEN 'critical' THEN 6.0 WHEN 'major' THEN 3.0 WHEN 'minor' THEN 1.5 ELSE 0.0 END) AS penalty, least(count(*) FILTER (severity = 'green')*1.5, 10.0) AS bonus FROM fl GROUP BY 1)
SELECT *, CASE WHEN final >= 75 THEN 'STRONG BUY' WHEN final >= 60 THEN 'BUY' WHEN final >= 45 THEN 'HOLD' WHEN final >= 30 THEN 'SELL / AVOID' ELSE 'STRONG AVOID' END AS label FROM (SELECT ba.symbol, base, coalesce(penalty, 0) AS penalty, coalesce(bonus, 0) AS bonus, greatest(0, least(100, base - coalesce(penalty, 0) + coalesce(bonus, 0))) AS final FROM ba LEFT JOIN pe ON ba.symbol = pe.symbol)"""
R.add("fun_20_overall_score", "symbol base~ penalty~ bonus~ final~ label", lambda t: A.overall(A.technique_scores(t.fundamentals_in_order), raised_flags(t)), OVERALL_SQL)
R.add("fun_20_flags", "symbol rule severity", raised_flags, f"WITH {FLAG_WITH} SELECT * FROM fl")
def adjustments(t):
    """Per symbol what the other operators say: alpha, insiders and ratings from filings, stakes and holdings, technical trend, P/E band.

    Three of them look at the bars, so these are made once and kept in the shared folder.
    """
    bars = written(t.bars, "bars")
    deals = T.insider_sentiment(T.insider_action(t.filings)).select("symbol", F.col("sentiment").alias("insider"))
    stakes = O.shareholding_trend(t.stakes.select("ticker", "as_of", F.col("pct").alias("promoter_pct"), F.lit(0.0).alias("public_pct"))).select(F.col("ticker").alias("symbol"), F.col("trend").alias("promoter"))
    held = t.holdings.groupBy("symbol").agg((F.sum("quantity") / 30).alias("institutional_pct"), F.count("*").alias("n_funds"))
    x = S.multi_horizon_alpha(bars, t.bench).select("symbol", F.round("alpha", 6).alias("alpha"))
    for more in (S.technical_structure(bars).select("symbol", "trend"), deals, stakes, T.rating_trajectory(t.filings).select("symbol", "trajectory"), held, band_places(bars, t.fundamentals)):
        x = x.join(more, "symbol", "full")
    return x


def pe_band(bars, fundamentals):
    """Last close over the newest earnings within five years of highs and lows over them, and the price within its 52 weeks; earnings of 0 or less have no band."""
    five, year = S.last_rows(1260), S.last_rows(252)
    spans = bars.select("symbol", "date", "close", F.max("high").over(five).alias("hi"), F.min("low").over(five).alias("lo"), F.avg("close").over(five).alias("mean"), F.max("high").over(year).alias("hi1"), F.min("low").over(year).alias("lo1"))
    x = spans.withColumn("rn", F.row_number().over(S.from_end())).where("rn = 1").drop("rn").join(A.annual(fundamentals).where("rn = 1").select("symbol", "eps"), "symbol")
    over = lambda c: F.when(F.col("eps") > 0, ratio(c, "eps"))
    x = x.select("symbol", over("close").alias("pe"), over("hi").alias("pe_high"), over("lo").alias("pe_low"), over("mean").alias("pe_avg"), F.when(F.col("hi1") > F.col("lo1"), ratio(F.col("close") - F.col("lo1"), F.col("hi1") - F.col("lo1")) * 100).alias("range52"))
    return x.withColumn("band", F.when(F.col("pe_high") > F.col("pe_low"), ratio(F.col("pe") - F.col("pe_low"), F.col("pe_high") - F.col("pe_low")) * 100))


def band_places(bars, fundamentals):
    return pe_band(bars, fundamentals).select("symbol", F.round("band", 6).alias("pe_percentile"))


def governance(t):
    """What the scan of a company's reports found in any of them."""
    return T.report_counts(t.filings).groupBy("symbol").agg(F.max("auditor_concern").alias("auditor_concern"), F.max("high_related_party").alias("high_related_party"))


PE_SQL = """WITH x AS (SELECT *, max(high) OVER a AS hi, min(low) OVER a AS lo, avg(close) OVER a AS mean, max(high) OVER b AS hi1, min(low) OVER b AS lo1, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn
  FROM bars WINDOW a AS (PARTITION BY symbol ORDER BY date ROWS 1259 PRECEDING), b AS (PARTITION BY symbol ORDER BY date ROWS 251 PRECEDING))
SELECT x.symbol, CASE WHEN eps > 0 THEN close/eps END AS pe, CASE WHEN eps > 0 THEN hi/eps END AS pe_high, CASE WHEN eps > 0 THEN lo/eps END AS pe_low, CASE WHEN eps > 0 THEN mean/eps END AS pe_avg,
  CASE WHEN eps > 0 AND hi > lo THEN (close - lo)/(hi - lo)*100 END AS band, CASE WHEN hi1 > lo1 THEN (close - lo1)/(hi1 - lo1)*100 END AS range52
FROM x JOIN annual_rows f ON x.symbol = f.symbol AND f.rn = 1 WHERE x.rn = 1"""
GOVERNANCE_SQL = "SELECT symbol, bool_or(auditor > 0) AS auditor_concern, bool_or(related_party > 10) AS high_related_party FROM (SELECT symbol, " + ", ".join(" + ".join(f"len(regexp_extract_all(lower(text), {q(p)}))" for p in T.FAMILIES[n]) + f" AS {n}" for n in ("auditor", "related_party")) + " FROM filings) GROUP BY 1"
RISK_SQL = f"""{REVERSE_SQL}, ds AS (SELECT symbol, CASE WHEN ebitda > 0 THEN total_debt / ebitda END AS debt_ebitda FROM annual_rows WHERE rn = 1), eq AS ({HAND_SQL['fun_24_earnings_quality']}), pb AS ({PE_SQL}), gv AS ({GOVERNANCE_SQL}),
rk AS (SELECT ds.symbol, avg_cfo_pat, avg_accrual, margin_of_safety, CASE WHEN debt_ebitda > 4 THEN 3.0 WHEN debt_ebitda > 2 THEN 1.5 ELSE 0.0 END + CASE WHEN round(band, 6) > 85 THEN 2 WHEN round(band, 6) > 65 THEN 1 ELSE 0 END + CASE WHEN avg_cfo_pat < 0.5 THEN 2.0 WHEN avg_cfo_pat < 0.7 THEN 1.0 ELSE 0.0 END
  + CASE WHEN auditor_concern THEN 1 ELSE 0 END + CASE WHEN high_related_party THEN 1 ELSE 0 END + CASE WHEN implied > 0.30 THEN 1.0 ELSE 0.0 END AS risk
  FROM ds LEFT JOIN eq ON ds.symbol = eq.symbol LEFT JOIN rv ON ds.symbol = rv.symbol LEFT JOIN pb ON ds.symbol = pb.symbol LEFT JOIN gv ON ds.symbol = gv.symbol)"""
R.add("fun_28_risk", "symbol risk~ kind", lambda t: A.risk(t.fundamentals, band_places(t.bars, t.fundamentals), governance(t)), f"{RISK_SQL} SELECT *, CASE WHEN risk >= 7 THEN 'HIGH RISK' WHEN risk >= 4 THEN 'MODERATE RISK' ELSE 'LOW RISK' END AS kind FROM rk")
R.add("win_32_pe_band", "symbol pe~ pe_high~ pe_low~ pe_avg~ band~ range52~", lambda t: pe_band(t.bars, t.fundamentals), PE_SQL)
DEEP_SQL = f"""{RISK_SQL}, mo AS ({MOAT_SQL}), qm AS ({MOMENTUM_SQL}), al AS ({SERIES_SQL['win_20_multi_horizon_alpha']}), te AS ({SERIES_SQL['win_19_technical_structure']}), rt AS ({TEXT_SQL['agg_26_rating_trajectory']}),
ins AS (SELECT symbol, sentiment AS insider FROM ({TEXT_SQL['agg_22_insider_sentiment']})),
st AS (SELECT symbol, CASE WHEN new > old + 1.5 THEN 'increasing' WHEN new < old - 1.5 THEN 'decreasing' ELSE 'stable' END AS promoter FROM (SELECT ticker AS symbol, avg(pct) FILTER (rn <= 2) AS new, avg(pct) FILTER (rn BETWEEN m - 1 AND m) AS old
  FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY as_of DESC) AS rn, least(count(*) OVER (PARTITION BY ticker), 8) AS m FROM stakes) WHERE m >= 4 GROUP BY 1)),
he AS (SELECT symbol, sum(quantity)/30.0 AS institutional_pct, count(*) AS n_funds FROM holdings GROUP BY 1),
dp AS (SELECT rk.symbol, risk, avg_cfo_pat, avg_accrual, margin_of_safety, moat, revenue_cagr, acceleration, alpha, te.trend, trajectory, insider, promoter, institutional_pct, n_funds, round(band, 6) AS pe_percentile
  FROM rk JOIN mo ON rk.symbol = mo.symbol LEFT JOIN qm ON rk.symbol = qm.symbol LEFT JOIN al ON rk.symbol = al.symbol LEFT JOIN te ON rk.symbol = te.symbol LEFT JOIN rt ON rk.symbol = rt.symbol
  LEFT JOIN pb ON rk.symbol = pb.symbol LEFT JOIN ins ON rk.symbol = ins.symbol LEFT JOIN st ON rk.symbol = st.symbol LEFT JOIN he ON rk.symbol = he.symbol) {nested('SELECT * FROM dp', A.DEEP)}"""
R.add("fun_29_deep_score", "symbol valuation~ growth~ earnings~ bonus# final~ label", lambda t: A.deep(t.fundamentals, adjustments(t), t.quarters, governance(t)), DEEP_SQL)
R.add("agg_17_first_digits", "key total# chi_square~ mad~ conformity", lambda t: A.benford(t.table("lineitem"), "l_suppkey", "l_extendedprice"), """WITH c AS (SELECT l_suppkey AS key, CAST(regexp_extract(printf('%.10e', abs(l_extendedprice)), '[1-9]') AS INT) AS d FROM lineitem WHERE l_extendedprice <> 0), n AS (SELECT key, d, count(*) AS n FROM c GROUP BY 1, 2), t AS (SELECT key, sum(n) AS total FROM n GROUP BY 1 HAVING sum(n) >= 50),
g AS (SELECT t.key, total, dd.d, coalesce(n.n, 0) AS n, log10(1 + 1.0/dd.d) AS share FROM t CROSS JOIN (SELECT unnest(range(1, 10)) AS d) dd LEFT JOIN n ON n.key = t.key AND n.d = dd.d), r AS (SELECT key, max(total) AS total, sum(pow(n - share*total, 2)/(share*total)) AS chi_square, sum(abs(n/total::DOUBLE - share)*100)/9 AS mad FROM g GROUP BY 1)
SELECT *, CASE WHEN chi_square > 20.09 THEN 'FAIL' WHEN chi_square > 15.507 THEN 'MARGINAL' ELSE 'PASS' END AS conformity FROM r""")
R.add("top_09_best_source", "symbol source", lambda t: A.best_source(t.fundamentals.withColumn("source", F.when(F.col("fy") % 3 == 0, "A").when(F.col("fy") % 3 == 1, "B").otherwise("C")).groupBy("symbol", "source").agg(F.count("*").alias("years"), (F.min("fy") % 2 == 0).alias("has_info"), F.max("fy").alias("price_rows"))), """WITH c AS (SELECT symbol, CASE fy % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS source, count(*) AS years, min(fy) % 2 = 0 AS has_info, max(fy) AS price_rows FROM fundamentals GROUP BY 1, 2) SELECT symbol, source FROM c QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY years DESC, has_info DESC, price_rows DESC, source) = 1""")


def newest_multiples(t):
    newest = A.annual(t.fundamentals).where("rn = 1").join(t.membership, "symbol")
    return newest.select("symbol", F.col("universe").alias("sector"), ratio("market_cap", "net_income").alias("pe"), ratio("market_cap", "equity").alias("pb"))


R.add(
    "agg_27_peers",
    "symbol peer_pe~ pe_discount~ peer_pb~ pb_discount~",
    lambda t: A.peer_comparison(newest_multiples(t)),
    """WITH c AS (SELECT f.symbol, universe AS sector, market_cap/nullif(net_income,0) AS pe, market_cap/nullif(equity,0) AS pb FROM annual_rows f JOIN membership m ON f.symbol = m.symbol WHERE rn = 1),
    p AS (SELECT a.symbol, a.pe, a.pb, avg(b.pe) FILTER (b.pe > 0) AS peer_pe, avg(b.pb) FILTER (b.pb > 0) AS peer_pb FROM c a LEFT JOIN c b ON a.sector = b.sector AND a.symbol <> b.symbol GROUP BY 1, 2, 3)
    SELECT *, (1-pe/peer_pe)*100 AS pe_discount, (1-pb/peer_pb)*100 AS pb_discount FROM p""",
)
R.add(
    "agg_31_comparison_sheet",
    "symbol " + " ".join(f"{c}~" for c in A.COMPARED),
    lambda t: A.comparison_sheet(
        t.fundamentals,
        t.bars,
        P.beta_table(t.bars, t.bench),
        t.stakes.groupBy(F.col("ticker").alias("symbol")).agg(F.max_by("pct", "as_of").alias("promoter_pct"), F.min_by("pct", "as_of").alias("pledged_pct")),
    ),
    f"""WITH x AS (SELECT *, lag(revenue, 3) OVER w AS r3, lag(net_income, 3) OVER w AS p3 FROM annual_rows WINDOW w AS (PARTITION BY symbol ORDER BY fy)),
    pr AS (SELECT symbol, arg_min(close, k) AS cmp, max(high) AS high_52w, min(low) AS low_52w, CASE WHEN count(*) > 20 THEN (arg_min(close, k)/arg_max(close, k) - 1)*100 END AS return_1y_pct
      FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM bars) WHERE k <= 252 GROUP BY 1),
    be AS ({PORTFOLIO_SQL['agg_12_beta_volatility_drawdown']}), st AS (SELECT ticker, arg_max(pct, as_of) AS promoter_pct, arg_min(pct, as_of) AS pledged_pct FROM stakes GROUP BY 1)
    SELECT x.symbol, market_cap/1e7 AS market_cap_cr, market_cap/nullif(net_income, 0) AS trailing_pe,
      market_cap/nullif(net_income, 0)/nullif(CASE WHEN net_income_1 > 0 THEN net_income/net_income_1 END, 0) AS forward_pe,
      market_cap/nullif(equity, 0) AS pb, (market_cap + total_debt - cash)/nullif(ebitda, 0) AS ev_ebitda, market_cap/nullif(revenue, 0) AS ps, -dividends_paid/nullif(market_cap, 0)*100 AS div_yield_pct,
      net_income/nullif(equity, 0)*100 AS roe_pct, net_income/nullif(total_assets, 0)*100 AS roa_pct, CASE WHEN total_assets > current_liabilities THEN ebit/(total_assets - current_liabilities)*100 END AS roce_pct,
      operating_inc/nullif(revenue, 0)*100 AS opm_pct, net_income/nullif(revenue, 0)*100 AS npm_pct, eps,
      CASE WHEN revenue_1 > 0 THEN revenue/revenue_1*100 - 100 END AS rev_growth_pct, CASE WHEN net_income_1 > 0 THEN net_income/net_income_1*100 - 100 END AS earn_growth_pct,
      CASE WHEN revenue > 0 AND r3 > 0 THEN cbrt(revenue/r3)*100 - 100 END AS rev_cagr_3y_pct, CASE WHEN net_income > 0 AND p3 > 0 THEN cbrt(net_income/p3)*100 - 100 END AS pat_cagr_3y_pct,
      total_debt/nullif(equity, 0) AS de_ratio, current_assets/nullif(current_liabilities, 0) AS current_ratio, ebit/nullif(abs(interest_exp), 0) AS interest_coverage,
      promoter_pct, pledged_pct, cmp, high_52w, low_52w, return_1y_pct, beta
    FROM x LEFT JOIN pr ON x.symbol = pr.symbol LEFT JOIN be ON x.symbol = be.symbol LEFT JOIN st ON x.symbol = st.ticker WHERE x.rn = 1""",
)
R.add(
    "fun_18_promoter_change",
    "ticker promoter_pct~ pledge_pct~ change~ rule severity",
    lambda t: A.promoter_flags(PROMOTERS(t)),
    """WITH x AS (SELECT ticker, pct * 3 AS p, pct * 3 - lag(pct * 3) OVER (PARTITION BY ticker ORDER BY as_of) AS change, CASE WHEN ticker % 4 <> 0 THEN greatest(0, (pct * 7) % 90 - 15) END AS pledge, row_number() OVER (PARTITION BY ticker ORDER BY as_of DESC) AS rn FROM stakes),
    r AS (SELECT ticker, p, pledge, change, unnest([CASE WHEN p < 25 THEN 'low_promoter:major' WHEN p > 70 THEN 'high_promoter:green' END, CASE WHEN pledge > 50 THEN 'pledge_very_high:critical' WHEN pledge > 20 THEN 'pledge_high:major' WHEN pledge > 0 THEN 'pledge:minor' WHEN pledge = 0 THEN 'no_pledge:green' END,
      CASE WHEN change < -3 THEN 'promoter_sold:major' WHEN change > 2 THEN 'promoter_bought:green' END]) AS f FROM x WHERE rn = 1)
    SELECT ticker, p AS promoter_pct, pledge AS pledge_pct, change, split_part(f, ':', 1) AS rule, split_part(f, ':', 2) AS severity FROM r WHERE f IS NOT NULL""",
)
R.add("fun_19_surveillance_flag", "symbol listed", lambda t: t.membership.join(t.table("supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("symbol"), F.lit(True).alias("l")), "symbol", "left").select("symbol", F.coalesce("l", F.lit(False)).alias("listed")), "SELECT m.symbol, s_acctbal < 0 AS listed FROM membership m JOIN supplier ON m.symbol = s_suppkey")
R.add("flt_01_flt_03_ratio_and_change", "symbol fy margin~ change~", lambda t: A.annual(t.fundamentals).select("symbol", "fy", ratio("net_income", F.col("revenue") - F.col("revenue")).alias("none"), ratio("net_income", "revenue").alias("margin"), (ratio(F.col("net_income") - F.col("net_income_1"), F.abs("net_income_1")) * 100).alias("change")), "SELECT symbol, fy, net_income/revenue AS margin, (net_income-net_income_1)/abs(net_income_1)*100 AS change FROM annual_rows")
R.add("flt_02_alias_lookup", "symbol fy value~", lambda t: t.fundamentals.select("symbol", "fy", (F.coalesce(F.when(F.col("fy") % 3 == 0, F.col("gross_profit")), F.when(F.col("fy") % 2 == 0, F.col("ebitda")), F.col("ebit")) / 1000).alias("value")), "SELECT symbol, fy, coalesce(CASE WHEN fy % 3 = 0 THEN gross_profit END, CASE WHEN fy % 2 = 0 THEN ebitda END, ebit)/1000 AS value FROM fundamentals")
QUERIES, ORACLE = R.queries, R.oracle
