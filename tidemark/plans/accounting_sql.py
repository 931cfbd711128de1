"""SQL of the accounting scores, written out from their definitions and not made from the operators' expressions.

ROWS are over annual_rows (a company and year, last year's items as x_1), SPANS
over the newest years of a company (rn counts from the newest). A quotient by 0
is null. Each value is the spec of the columns and the SQL.
"""

from __future__ import annotations

ROWS: dict[str, tuple[str, str]] = {
    "fun_01_beneish_m": (
        "dsri~ gmi~ aqi~ sgi~ depi~ sgai~ tata~ lvgi~ m_score~ verdict score~",
        """WITH q AS (SELECT symbol, fy, receivables / nullif(revenue, 0) AS recv, receivables_1 / nullif(revenue_1, 0) AS recv_1, gross_profit / nullif(revenue, 0) AS gm, gross_profit_1 / nullif(revenue_1, 0) AS gm_1,
  CASE WHEN total_assets <> 0 THEN 1 - (current_assets + ppe_net) / total_assets ELSE 0 END AS soft, CASE WHEN total_assets_1 <> 0 THEN 1 - (current_assets_1 + ppe_net_1) / total_assets_1 ELSE 0 END AS soft_1,
  revenue / nullif(revenue_1, 0) AS sales, depreciation / nullif(depreciation + ppe_net, 0) AS wear, depreciation_1 / nullif(depreciation_1 + ppe_net_1, 0) AS wear_1,
  sga / nullif(revenue, 0) AS cost, sga_1 / nullif(revenue_1, 0) AS cost_1, (net_income - operating_cf) / nullif(total_assets, 0) AS accruals,
  total_debt / nullif(total_assets, 0) AS lev, total_debt_1 / nullif(total_assets_1, 0) AS lev_1 FROM annual_rows),
c AS (SELECT symbol, fy, coalesce(recv / nullif(recv_1, 0), 1) AS dsri, coalesce(gm_1 / nullif(gm, 0), 1) AS gmi, coalesce(soft / nullif(soft_1, 0), 1) AS aqi, coalesce(sales, 1) AS sgi,
  coalesce(wear_1 / nullif(wear, 0), 1) AS depi, coalesce(cost / nullif(cost_1, 0), 1) AS sgai, coalesce(accruals, 0) AS tata, coalesce(lev / nullif(lev_1, 0), 1) AS lvgi FROM q),
m AS (SELECT *, 0.920 * dsri + 0.528 * gmi + 0.404 * aqi + 0.892 * sgi + 0.115 * depi - 0.172 * sgai + 4.679 * tata - 0.327 * lvgi - 4.84 AS m_score FROM c)
SELECT *, if(m_score > -1.78, 'LIKELY MANIPULATOR', 'Non-Manipulator') AS verdict, CASE WHEN m_score >= -1.0 THEN 1 WHEN m_score >= -1.78 THEN 4 WHEN m_score >= -2.5 THEN 7 ELSE 10 END AS score FROM m""",
    ),
    "fun_02_altman_z": (
        "z_score~ zone score~",
        """WITH z AS (SELECT symbol, fy, CASE WHEN total_assets <> 0 THEN (1.2 * coalesce(working_capital, 0) + 1.4 * coalesce(retained_earnings, 0) + 3.3 * coalesce(ebit, 0) + coalesce(revenue, 0)) / total_assets ELSE 0 END
  + CASE WHEN total_liabilities <> 0 THEN 0.6 * coalesce(market_cap, 0) / total_liabilities ELSE 0 END AS z_score FROM annual_rows)
SELECT *, CASE WHEN z_score <= 1.81 THEN 'DISTRESS ZONE' WHEN z_score <= 2.99 THEN 'GREY ZONE' ELSE 'SAFE ZONE' END AS zone, CASE WHEN z_score <= 1.81 THEN 1 WHEN z_score <= 2.99 THEN 5 ELSE 10 END AS score FROM z""",
    ),
    "fun_03_piotroski_f": (
        "f_score~ verdict score~",
        """WITH p AS (SELECT symbol, fy, list_sum(list_transform([net_income / nullif(total_assets, 0) > 0, operating_cf > 0, net_income / nullif(total_assets, 0) > net_income_1 / nullif(total_assets_1, 0), operating_cf > net_income,
  long_term_debt <= long_term_debt_1, current_assets / nullif(current_liabilities, 0) > current_assets_1 / nullif(current_liabilities_1, 0), coalesce(shares_outstanding <= 1.01 * shares_outstanding_1, true),
  gross_profit / nullif(revenue, 0) > gross_profit_1 / nullif(revenue_1, 0), revenue / nullif(total_assets, 0) > revenue_1 / nullif(total_assets_1, 0)], lambda x: CASE WHEN x THEN 1 ELSE 0 END)) AS f_score FROM annual_rows)
SELECT *, CASE WHEN f_score < 5 THEN 'WEAK' WHEN f_score < 8 THEN 'MODERATE' ELSE 'STRONG' END AS verdict, CASE WHEN f_score < 5 THEN 2 WHEN f_score < 8 THEN 6 ELSE 10 END AS score FROM p""",
    ),
    "fun_04_dupont": (
        "net_margin~ asset_turnover~ equity_multiplier~ roe~",
        """SELECT symbol, fy, 100 * net_income / nullif(revenue, 0) AS net_margin, revenue / nullif(total_assets, 0) AS asset_turnover, total_assets / nullif(equity, 0) AS equity_multiplier, 100 * net_income / nullif(equity, 0) AS roe FROM annual_rows""",
    ),
    "fun_05_margins": (
        "gross_margin~ operating_margin~ net_margin~ ebitda_margin~ score~",
        """WITH m AS (SELECT symbol, fy, 100 * gross_profit / nullif(revenue, 0) AS gross_margin, 100 * operating_inc / nullif(revenue, 0) AS operating_margin, 100 * net_income / nullif(revenue, 0) AS net_margin, 100 * ebitda / nullif(revenue, 0) AS ebitda_margin FROM annual_rows)
SELECT *, CASE WHEN operating_margin IS NULL THEN 5 WHEN operating_margin <= 5 THEN 3 WHEN operating_margin <= 12 THEN 5 WHEN operating_margin <= 20 THEN 7 ELSE 9 END AS score FROM m""",
    ),
    "fun_07_working_capital_days": (
        "dso~ dio~ dpo~ ccc~ current_ratio~ dio_surge dso_surge stuffing score~",
        """WITH d AS (SELECT *, 365 * receivables / nullif(revenue, 0) AS dso, 365 * inventory / nullif(cogs, 0) AS dio, 365 * payables / nullif(cogs, 0) AS dpo, 365 * receivables_1 / nullif(revenue_1, 0) AS dso_1, 365 * inventory_1 / nullif(cogs_1, 0) AS dio_1,
  current_assets / nullif(current_liabilities, 0) AS current_ratio FROM annual_rows)
SELECT symbol, fy, dso, dio, dpo, dso + dio - dpo AS ccc, current_ratio, coalesce((dio - dio_1) / nullif(abs(dio_1), 0) > 0.30, false) AS dio_surge, coalesce((dso - dso_1) / nullif(abs(dso_1), 0) > 0.30, false) AS dso_surge,
  coalesce(revenue_1 > 0 AND receivables_1 > 0 AND (receivables / nullif(receivables_1, 0) - 1) * 100 > (revenue / nullif(revenue_1, 0) - 1) * 100 + 20, false) AS stuffing,
  CASE WHEN current_ratio < 1 THEN 3 WHEN current_ratio > 1.5 THEN 8 ELSE 6 END AS score FROM d""",
    ),
    "fun_08_leverage": (
        "de~ da~ coverage~ net_debt~ net_de~ rising score~",
        """WITH d AS (SELECT symbol, fy, total_debt / nullif(equity, 0) AS de, total_debt_1 / nullif(equity_1, 0) AS de_1, 100 * total_debt / nullif(total_assets, 0) AS da, CASE WHEN interest_exp > 0 THEN ebit / interest_exp END AS coverage,
  total_debt - cash AS net_debt, (total_debt - cash) / nullif(equity, 0) AS net_de FROM annual_rows),
s AS (SELECT *, CASE WHEN de < 0.5 THEN 9 WHEN de <= 2 THEN 6 WHEN de <= 3 THEN 4 WHEN de > 3 THEN 2 ELSE 6 END AS plain FROM d)
SELECT * EXCLUDE (plain, de_1), coalesce(de > de_1 * 1.3, false) AS rising, CASE WHEN coverage < 1.5 THEN least(plain, 2) ELSE plain END AS score FROM s""",
    ),
    "fun_09_return_ratios": (
        "roe~ roa~ roce~ tax_rate~ capex_dep~",
        """SELECT symbol, fy, 100 * net_income / nullif(equity, 0) AS roe, 100 * net_income / nullif(total_assets, 0) AS roa, 100 * ebit / nullif(equity + total_debt, 0) AS roce, 100 * tax / nullif(pretax_income, 0) AS tax_rate, abs(capex) / nullif(depreciation, 0) AS capex_dep FROM annual_rows""",
    ),
    "fun_12_forensic_checks": (
        "negative_equity intangible_ratio~ payout_income~ payout_fcf~ cash_conversion~ roic~ quick_ratio~",
        """SELECT symbol, fy, coalesce(equity < 0, false) AS negative_equity, (coalesce(goodwill, 0) + coalesce(intangibles, 0)) / nullif(total_assets, 0) * 100 AS intangible_ratio,
  CASE WHEN dividends_paid < 0 AND net_income > 0 THEN -dividends_paid / net_income * 100 END AS payout_income, CASE WHEN dividends_paid < 0 AND fcf > 0 THEN -dividends_paid / fcf * 100 END AS payout_fcf,
  CASE WHEN net_income > 0 THEN fcf / net_income * 100 END AS cash_conversion,
  ebit * (1 - CASE WHEN tax IS NULL OR pretax_income IS NULL OR pretax_income = 0 THEN 0.25 ELSE tax / pretax_income END) / nullif(CASE WHEN invested_capital IS NULL THEN equity + total_debt ELSE invested_capital END, 0) * 100 AS roic,
  (current_assets - coalesce(inventory, 0)) / nullif(current_liabilities, 0) AS quick_ratio FROM annual_rows""",
    ),
    "fun_13_montier_c": (
        "c_score~ verdict score~",
        """WITH d AS (SELECT *, current_assets - cash - receivables - inventory AS other, current_assets_1 - cash_1 - receivables_1 - inventory_1 AS other_1 FROM annual_rows),
c AS (SELECT symbol, fy, CASE WHEN fy_1 IS NULL THEN NULL ELSE list_sum(list_transform([net_income > net_income_1 AND operating_cf < operating_cf_1, CASE WHEN revenue > 0 AND revenue_1 > 0 THEN receivables / revenue * 365 > receivables_1 / revenue_1 * 365 * 1.05 END,
  CASE WHEN cogs > 0 AND cogs_1 > 0 THEN inventory / cogs * 365 > inventory_1 / cogs_1 * 365 * 1.05 END, CASE WHEN revenue > 0 AND revenue_1 > 0 THEN other / revenue > other_1 / revenue_1 * 1.10 END,
  CASE WHEN ppe_gross > 0 AND ppe_gross_1 > 0 THEN depreciation / ppe_gross < depreciation_1 / ppe_gross_1 * 0.90 END, CASE WHEN total_assets_1 > 0 THEN total_assets / total_assets_1 - 1 > 0.10 END],
  lambda x: CASE WHEN x THEN 1 ELSE 0 END)) END AS c_score FROM d)
SELECT *, CASE WHEN c_score < 2 THEN 'LOW RISK' WHEN c_score < 4 THEN 'MODERATE RISK' WHEN c_score >= 4 THEN 'HIGH MANIPULATION RISK' END AS verdict, CASE WHEN c_score < 2 THEN 9 WHEN c_score < 4 THEN 5 WHEN c_score >= 4 THEN 2 END AS score FROM c""",
    ),
    "fun_14_ohlson_o": (
        "o_score~ probability~ verdict score~",
        """WITH o AS (SELECT symbol, fy, -1.32 - 0.407 * CASE WHEN total_assets > 0 THEN ln(total_assets) ELSE 0 END + coalesce((6.03 * total_liabilities) / nullif(total_assets, 0), 0) - coalesce((1.43 * working_capital) / nullif(total_assets, 0), 0)
  + coalesce(0.0757 * current_liabilities / nullif(current_assets, 0), 0) - if(coalesce(total_liabilities > total_assets, false), 1.72, 0) - coalesce(2.37 * net_income / nullif(total_assets, 0), 0) - coalesce(1.83 * operating_cf / nullif(total_liabilities, 0), 0)
  + if(coalesce(net_income < 0 AND net_income_1 < 0, false), 0.285, 0) - coalesce(0.521 * (net_income - net_income_1) / nullif(abs(net_income) + abs(net_income_1), 0), 0) AS o_score FROM annual_rows),
p AS (SELECT *, 1 / (1 + exp(-o_score)) AS probability FROM o)
SELECT *, CASE WHEN probability <= 0.3 THEN 'LOW RISK' WHEN probability <= 0.5 THEN 'ELEVATED RISK' ELSE 'HIGH BANKRUPTCY RISK' END AS verdict, CASE WHEN probability <= 0.3 THEN 9 WHEN probability <= 0.5 THEN 4 ELSE 1 END AS score FROM p""",
    ),
    "fun_15_sustainable_growth": (
        "payout~ retention~ sgr~ growth~ gap~ score~",
        """WITH p AS (SELECT *, CASE WHEN net_income > 0 AND dividends_paid < 0 THEN -dividends_paid / net_income ELSE 0 END AS payout FROM annual_rows),
s AS (SELECT symbol, fy, payout, 1 - least(payout, 1) AS retention, net_income / nullif(equity, 0) * (1 - least(payout, 1)) * 100 AS sgr, CASE WHEN revenue_1 > 0 THEN revenue / revenue_1 * 100 - 100 END AS growth FROM p)
SELECT *, growth - sgr AS gap, CASE WHEN growth - sgr >= 10 THEN 2 WHEN growth - sgr >= 5 THEN 4 WHEN growth - sgr >= 0 THEN 7 WHEN growth - sgr < 0 THEN 9 END AS score FROM s""",
    ),
    "fun_17_springate_s": (
        "s_score~ verdict score~",
        """WITH s AS (SELECT symbol, fy, coalesce(1.03 * working_capital / nullif(total_assets, 0), 0) + coalesce(3.07 * ebit / nullif(total_assets, 0), 0) + coalesce(0.66 * pretax_income / nullif(current_liabilities, 0), 0) + coalesce(0.4 * revenue / nullif(total_assets, 0), 0) AS s_score FROM annual_rows)
SELECT *, if(s_score < 0.862, 'DISTRESS (bankruptcy risk)', 'HEALTHY') AS verdict, if(s_score < 0.862, 2, 9) AS score FROM s""",
    ),
    "fun_25_debt_stress": (
        "net_debt~ net_cash icr~ icr_2x~ icr_3x~ icr_down_30~ debt_ebitda~ net_debt_equity~ short_mix~",
        """WITH d AS (SELECT symbol, fy, ebitda, equity, coalesce(total_debt, 0) AS debt, coalesce(total_debt, 0) - coalesce(cash, 0) AS net_debt, CASE WHEN interest_exp <> 0 THEN abs(interest_exp) END AS interest,
  CASE WHEN current_debt IS NULL THEN coalesce(total_debt, 0) - coalesce(long_term_debt, 0) ELSE current_debt END AS short FROM annual_rows)
SELECT symbol, fy, net_debt, net_debt < 0 AS net_cash, ebitda / interest AS icr, ebitda / (2 * interest) AS icr_2x, ebitda / (3 * interest) AS icr_3x, 0.7 * ebitda / interest AS icr_down_30, CASE WHEN ebitda > 0 THEN debt / ebitda END AS debt_ebitda,
  CASE WHEN equity > 0 THEN net_debt / equity END AS net_debt_equity, CASE WHEN debt > 0 THEN short / debt * 100 ELSE 0 END AS short_mix FROM d""",
    ),
}

#: The growth between the ends of a list of n yearly values, -100 where it ends at or below 0.
ENDS = "CASE WHEN n >= 2 AND {0}[n] > 0 THEN CASE WHEN {0}[1] > 0 THEN 100 * pow({0}[1] / {0}[n], 1.0 / (n - 1)) - 100 ELSE -100 END END"
SPANS: dict[str, tuple[str, str]] = {
    "fun_05_margin_trend": (
        "n# g0~ g9~ o0~ o9~ gross_falling gross_rising operating_falling",
        """WITH m AS (SELECT symbol, count(*) AS n, list(100 * gross_profit / nullif(revenue, 0) ORDER BY rn) AS g, list(100 * operating_inc / nullif(revenue, 0) ORDER BY rn) AS o FROM annual_rows WHERE rn <= 4 GROUP BY 1)
SELECT symbol, n, g[1] AS g0, g[n] AS g9, o[1] AS o0, o[n] AS o9, coalesce(n >= 3 AND g[1] < g[n] - 5, false) AS gross_falling, coalesce(n >= 3 AND g[1] > g[n] + 2, false) AS gross_rising, coalesce(n >= 3 AND o[1] < o[n] - 3, false) AS operating_falling FROM m""",
    ),
    "fun_06_cash_flow_quality": (
        "neg_cfo# neg_fcf# cfo_lt_ni# accrual~ score~",
        """WITH c AS (SELECT symbol, count(*) FILTER (operating_cf < 0) AS neg_cfo, count(*) FILTER (fcf < 0) AS neg_fcf, count(*) FILTER (net_income > 0 AND operating_cf < net_income) AS cfo_lt_ni, max((net_income - operating_cf) / nullif(total_assets, 0)) FILTER (rn = 1) AS accrual FROM annual_rows WHERE rn <= 4 GROUP BY 1)
SELECT *, CASE WHEN neg_cfo >= 2 THEN 2 WHEN cfo_lt_ni >= 2 THEN 4 WHEN neg_cfo + cfo_lt_ni = 0 THEN 9 ELSE 7 END AS score FROM c""",
    ),
    "fun_11_growth": (
        "n# revenue_yoy~ eps_growth~ revenue_cagr~ profit_cagr~",
        f"""WITH g AS (SELECT symbol, count(*) AS n, list(revenue ORDER BY rn) AS r, list(net_income ORDER BY rn) AS p, list(eps ORDER BY rn) AS e FROM annual_rows WHERE rn <= 4 GROUP BY 1)
SELECT symbol, n, CASE WHEN r[2] > 0 THEN 100 * r[1] / r[2] - 100 END AS revenue_yoy, CASE WHEN e[2] > 0 THEN 100 * e[1] / e[2] - 100 END AS eps_growth, {ENDS.format('r')} AS revenue_cagr, {ENDS.format('p')} AS profit_cagr FROM g""",
    ),
    "fun_12_loss_years": (
        "loss_years# pairs# under_investing~ capex_dep~",
        """WITH l AS (SELECT symbol, count(*) FILTER (net_income < 0) AS loss_years, count(*) FILTER (capex IS NOT NULL AND depreciation IS NOT NULL) AS pairs, count(*) FILTER (depreciation > 0 AND abs(capex) < depreciation * 0.8) AS low,
  sum(abs(capex)) FILTER (depreciation IS NOT NULL) AS spent, sum(depreciation) FILTER (capex IS NOT NULL) AS worn FROM annual_rows WHERE rn <= 4 GROUP BY 1)
SELECT symbol, loss_years, pairs, CASE WHEN pairs >= 2 THEN low END AS under_investing, spent / nullif(worn, 0) AS capex_dep FROM l""",
    ),
    "agg_28_earnings_volatility": (
        "n# cv~ margin_mean~ margin_sd~ margin_cv~ score~",
        """WITH v AS (SELECT symbol, count(net_income) AS n, CASE WHEN count(net_income) >= 3 THEN 100 * stddev_pop(net_income) / nullif(abs(avg(net_income)), 0) END AS cv, count(net_income) FILTER (revenue > 0) AS k,
  avg(100 * net_income / revenue) FILTER (revenue > 0) AS m, stddev_pop(100 * net_income / revenue) FILTER (revenue > 0) AS s FROM annual_rows WHERE rn <= 4 GROUP BY 1)
SELECT symbol, n, cv, CASE WHEN k >= 3 THEN m END AS margin_mean, CASE WHEN k >= 3 THEN s END AS margin_sd, CASE WHEN k >= 3 THEN 100 * s / nullif(abs(m), 0) END AS margin_cv, CASE WHEN cv >= 50 THEN 2 WHEN cv >= 30 THEN 4 WHEN cv >= 15 THEN 6 WHEN cv < 15 THEN 9 END AS score FROM v""",
    ),
    "fun_16_operating_leverage": (
        "avg_dol~ score~",
        """WITH y AS (SELECT symbol, rn, (ebit - lead(ebit) OVER w) / nullif(abs(lead(ebit) OVER w), 0) AS de, (revenue - lead(revenue) OVER w) / nullif(abs(lead(revenue) OVER w), 0) AS dr FROM annual_rows WHERE rn <= 4 WINDOW w AS (PARTITION BY symbol ORDER BY rn)),
a AS (SELECT symbol, avg(abs(de / nullif(dr, 0))) FILTER (abs(de / nullif(dr, 0)) < 50) AS avg_dol FROM y GROUP BY 1)
SELECT *, CASE WHEN avg_dol >= 5 THEN 2 WHEN avg_dol >= 3 THEN 4 WHEN avg_dol >= 1.5 THEN 6 WHEN avg_dol < 1.5 THEN 9 END AS score FROM a""",
    ),
    "fun_23_working_capital_trend": (
        "n# dso~ dio~ dpo~ trend",
        """WITH d AS (SELECT symbol, rn, CASE WHEN revenue > 0 THEN receivables / (revenue / 365) END AS so, CASE WHEN cogs > 0 THEN inventory / (cogs / 365) END AS io, CASE WHEN cogs > 0 THEN payables / (cogs / 365) END AS po FROM annual_rows WHERE rn <= 5),
s AS (SELECT symbol, max(so) FILTER (rn = 1) AS dso, max(io) FILTER (rn = 1) AS dio, max(po) FILTER (rn = 1) AS dpo, count(so + io - po) AS n, list(so + io - po ORDER BY rn) FILTER (so + io - po IS NOT NULL) AS c FROM d GROUP BY 1)
SELECT symbol, n, dso, dio, dpo, CASE WHEN n < 3 THEN 'stable' WHEN c[1] < c[n] - 5 THEN 'improving' WHEN c[1] > c[n] + 10 THEN 'deteriorating' ELSE 'stable' END AS trend FROM s""",
    ),
}
