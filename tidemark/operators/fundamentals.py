"""Accounting scores for all companies and years at once.

Every score is a set of expressions over one row a company and year with the
previous year's items beside it (`x_1` is last year's x), or over the newest
years of a company. The expressions are SQL text in which `div(a, b)` is null
where b is 0 or either is null; `spark()` turns it into Spark's own function.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio

ITEMS = (
    "revenue", "cogs", "tax", "receivables", "inventory", "total_debt", "total_assets", "net_income", "operating_cf", "gross_profit", "operating_inc", "depreciation", "ebit", "ebitda",
    "interest_exp", "sga", "pretax_income", "current_assets", "cash", "ppe_net", "payables", "current_liabilities", "working_capital", "long_term_debt", "total_liabilities", "equity",
    "retained_earnings", "intangibles", "capex", "fcf", "dividends_paid", "shares_outstanding", "market_cap", "eps", "ppe_gross", "goodwill", "current_debt", "invested_capital",
)
#: Items that not every statement has: null where the column is missing.
OPTIONAL = ("ppe_gross", "goodwill", "current_debt", "invested_capital")


def spark(e: str) -> Column:
    return F.expr(e.replace("div(", "try_divide("))


def annual(f: DataFrame) -> DataFrame:
    """f with last year's items as x_1, the year before's fy as fy_1 and the place of the year counted from the newest."""
    f = f.withColumns({c: F.lit(None).cast("double") for c in OPTIONAL if c not in f.columns})
    w = Window.partitionBy("symbol").orderBy("fy")
    items = [c for c in ITEMS if c in f.columns]
    return f.select("*", *[F.lag(c).over(w).alias(f"{c}_1") for c in ("fy", *items)], F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("fy"))).alias("rn"))


def _flags(*conditions: str) -> str:
    return " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in conditions)


#: Row scores: name, then column and expression in order; later ones may use earlier ones.
ROW_SCORES: dict[str, tuple[tuple[str, str], ...]] = {
    "fun_01_beneish_m": (
        ("dsri", "coalesce(div(div(receivables, revenue), div(receivables_1, revenue_1)), 1.0)"),
        ("gmi", "coalesce(div(div(gross_profit_1, revenue_1), div(gross_profit, revenue)), 1.0)"),
        ("aqi", "coalesce(div(1 - coalesce(div(current_assets + ppe_net, total_assets), 1.0), 1 - coalesce(div(current_assets_1 + ppe_net_1, total_assets_1), 1.0)), 1.0)"),
        ("sgi", "coalesce(div(revenue, revenue_1), 1.0)"),
        ("depi", "coalesce(div(div(depreciation_1, depreciation_1 + ppe_net_1), div(depreciation, depreciation + ppe_net)), 1.0)"),
        ("sgai", "coalesce(div(div(sga, revenue), div(sga_1, revenue_1)), 1.0)"),
        ("tata", "coalesce(div(net_income - operating_cf, total_assets), 0.0)"),
        ("lvgi", "coalesce(div(div(total_debt, total_assets), div(total_debt_1, total_assets_1)), 1.0)"),
        ("m_score", "-4.84 + 0.92*dsri + 0.528*gmi + 0.404*aqi + 0.892*sgi + 0.115*depi - 0.172*sgai + 4.679*tata - 0.327*lvgi"),
        ("verdict", "CASE WHEN m_score > -1.78 THEN 'LIKELY MANIPULATOR' ELSE 'Non-Manipulator' END"),
        ("score", "CASE WHEN m_score < -2.5 THEN 10 WHEN m_score < -1.78 THEN 7 WHEN m_score < -1.0 THEN 4 ELSE 1 END"),
    ),
    "fun_02_altman_z": (
        ("z_score", "1.2*coalesce(div(working_capital, total_assets), 0.0) + 1.4*coalesce(div(retained_earnings, total_assets), 0.0) + 3.3*coalesce(div(ebit, total_assets), 0.0) + 0.6*coalesce(div(market_cap, total_liabilities), 0.0) + coalesce(div(revenue, total_assets), 0.0)"),
        ("zone", "CASE WHEN z_score > 2.99 THEN 'SAFE ZONE' WHEN z_score > 1.81 THEN 'GREY ZONE' ELSE 'DISTRESS ZONE' END"),
        ("score", "CASE WHEN z_score > 2.99 THEN 10 WHEN z_score > 1.81 THEN 5 ELSE 1 END"),
    ),
    "fun_03_piotroski_f": (
        ("f_score", _flags("div(net_income, total_assets) > 0", "operating_cf > 0", "div(net_income, total_assets) > div(net_income_1, total_assets_1)", "operating_cf > net_income", "long_term_debt <= long_term_debt_1",
                           "div(current_assets, current_liabilities) > div(current_assets_1, current_liabilities_1)", "NOT coalesce(shares_outstanding > shares_outstanding_1 * 1.01, false)",
                           "div(gross_profit, revenue) > div(gross_profit_1, revenue_1)", "div(revenue, total_assets) > div(revenue_1, total_assets_1)")),
        ("verdict", "CASE WHEN f_score >= 8 THEN 'STRONG' WHEN f_score >= 5 THEN 'MODERATE' ELSE 'WEAK' END"),
        ("score", "CASE WHEN f_score >= 8 THEN 10 WHEN f_score >= 5 THEN 6 ELSE 2 END"),
    ),
    "fun_04_dupont": (("net_margin", "div(net_income, revenue)*100"), ("asset_turnover", "div(revenue, total_assets)"), ("equity_multiplier", "div(total_assets, equity)"), ("roe", "div(net_income, equity)*100")),
    "fun_05_margins": (("gross_margin", "div(gross_profit, revenue)*100"), ("operating_margin", "div(operating_inc, revenue)*100"), ("net_margin", "div(net_income, revenue)*100"), ("ebitda_margin", "div(ebitda, revenue)*100"),
                       ("score", "CASE WHEN operating_margin > 20 THEN 9 WHEN operating_margin > 12 THEN 7 WHEN operating_margin > 5 THEN 5 WHEN operating_margin IS NULL THEN 5 ELSE 3 END")),
    "fun_07_working_capital_days": (
        ("dso", "div(receivables, revenue)*365"), ("dio", "div(inventory, cogs)*365"), ("dpo", "div(payables, cogs)*365"), ("ccc", "dso + dio - dpo"), ("current_ratio", "div(current_assets, current_liabilities)"),
        ("dio_surge", "coalesce(div(dio - div(inventory_1, cogs_1)*365, abs(div(inventory_1, cogs_1)*365))*100 > 30, false)"), ("dso_surge", "coalesce(div(dso - div(receivables_1, revenue_1)*365, abs(div(receivables_1, revenue_1)*365))*100 > 30, false)"),
        ("stuffing", "coalesce(revenue_1 > 0 AND receivables_1 > 0 AND div(receivables, receivables_1) > div(revenue, revenue_1) + 0.2, false)"),
        ("score", "CASE WHEN current_ratio > 1.5 THEN 8 WHEN current_ratio < 1.0 THEN 3 ELSE 6 END"),
    ),
    "fun_08_leverage": (
        ("de", "div(total_debt, equity)"), ("da", "div(total_debt, total_assets)*100"), ("coverage", "CASE WHEN interest_exp > 0 THEN div(ebit, interest_exp) END"), ("net_debt", "total_debt - cash"), ("net_de", "div(total_debt - cash, equity)"),
        ("rising", "coalesce(de > div(total_debt_1, equity_1)*1.3, false)"),
        ("score", "CASE WHEN coverage < 1.5 THEN 2 WHEN de > 3 THEN 2 WHEN de > 2 THEN 4 WHEN de < 0.5 THEN 9 ELSE 6 END"),
    ),
    "fun_09_return_ratios": (("roe", "div(net_income, equity)*100"), ("roa", "div(net_income, total_assets)*100"), ("roce", "div(ebit, equity + total_debt)*100"), ("tax_rate", "div(tax, pretax_income)*100"), ("capex_dep", "div(abs(capex), depreciation)")),
    "fun_12_forensic_checks": (
        ("negative_equity", "coalesce(equity < 0, false)"), ("intangible_ratio", "div(coalesce(goodwill, 0) + coalesce(intangibles, 0), total_assets)*100"),
        ("payout_income", "CASE WHEN dividends_paid < 0 AND net_income > 0 THEN div(abs(dividends_paid), net_income)*100 END"), ("payout_fcf", "CASE WHEN dividends_paid < 0 AND fcf > 0 THEN div(abs(dividends_paid), fcf)*100 END"),
        ("cash_conversion", "CASE WHEN net_income > 0 THEN div(fcf, net_income)*100 END"), ("roic", "div(ebit*(1 - coalesce(div(tax, pretax_income), 0.25)), coalesce(invested_capital, total_debt + equity))*100"),
        ("quick_ratio", "div(current_assets - coalesce(inventory, 0), current_liabilities)"),
    ),
    "fun_13_montier_c": (
        ("signals", _flags("net_income > net_income_1 AND operating_cf < operating_cf_1", "revenue > 0 AND revenue_1 > 0 AND div(receivables, revenue) > div(receivables_1, revenue_1)*1.05", "cogs > 0 AND cogs_1 > 0 AND div(inventory, cogs) > div(inventory_1, cogs_1)*1.05",
                           "revenue > 0 AND revenue_1 > 0 AND div(current_assets - cash - receivables - inventory, revenue) > div(current_assets_1 - cash_1 - receivables_1 - inventory_1, revenue_1)*1.10",
                           "ppe_gross > 0 AND ppe_gross_1 > 0 AND div(depreciation, ppe_gross) < div(depreciation_1, ppe_gross_1)*0.90", "total_assets_1 > 0 AND div(total_assets, total_assets_1) - 1 > 0.10")),
        ("c_score", "CASE WHEN fy_1 IS NOT NULL THEN signals END"),
        ("verdict", "CASE WHEN c_score >= 4 THEN 'HIGH MANIPULATION RISK' WHEN c_score >= 2 THEN 'MODERATE RISK' WHEN c_score >= 0 THEN 'LOW RISK' END"),
        ("score", "CASE WHEN c_score >= 4 THEN 2 WHEN c_score >= 2 THEN 5 WHEN c_score >= 0 THEN 9 END"),
    ),
    "fun_14_ohlson_o": (
        ("o_score", "-1.32 - 0.407*CASE WHEN total_assets > 0 THEN ln(total_assets) ELSE 0 END + 6.03*coalesce(div(total_liabilities, total_assets), 0.0) - 1.43*coalesce(div(working_capital, total_assets), 0.0) + 0.0757*coalesce(div(current_liabilities, current_assets), 0.0)"
                    " - 1.72*CASE WHEN total_liabilities > total_assets THEN 1 ELSE 0 END - 2.37*coalesce(div(net_income, total_assets), 0.0) - 1.83*coalesce(div(operating_cf, total_liabilities), 0.0)"
                    " + 0.285*CASE WHEN net_income < 0 AND net_income_1 < 0 THEN 1 ELSE 0 END - 0.521*coalesce(div(net_income - net_income_1, abs(net_income) + abs(net_income_1)), 0.0)"),
        ("probability", "1.0 / (1.0 + exp(-o_score))"),
        ("verdict", "CASE WHEN probability > 0.5 THEN 'HIGH BANKRUPTCY RISK' WHEN probability > 0.3 THEN 'ELEVATED RISK' ELSE 'LOW RISK' END"),
        ("score", "CASE WHEN probability > 0.5 THEN 1 WHEN probability > 0.3 THEN 4 ELSE 9 END"),
    ),
    "fun_15_sustainable_growth": (
        ("payout", "CASE WHEN dividends_paid < 0 AND net_income > 0 THEN div(abs(dividends_paid), net_income) ELSE 0.0 END"), ("retention", "1 - least(payout, 1.0)"),
        ("sgr", "div(net_income, equity)*retention*100"), ("growth", "CASE WHEN revenue_1 > 0 THEN (div(revenue, revenue_1) - 1)*100 END"), ("gap", "growth - sgr"),
        ("score", "CASE WHEN gap < 0 THEN 9 WHEN gap < 5 THEN 7 WHEN gap < 10 THEN 4 WHEN gap >= 10 THEN 2 END"),
    ),
    "fun_17_springate_s": (
        ("s_score", "1.03*coalesce(div(working_capital, total_assets), 0.0) + 3.07*coalesce(div(ebit, total_assets), 0.0) + 0.66*coalesce(div(pretax_income, current_liabilities), 0.0) + 0.4*coalesce(div(revenue, total_assets), 0.0)"),
        ("verdict", "CASE WHEN s_score >= 0.862 THEN 'HEALTHY' ELSE 'DISTRESS (bankruptcy risk)' END"), ("score", "CASE WHEN s_score >= 0.862 THEN 9 ELSE 2 END"),
    ),
    "fun_25_debt_stress": (
        ("interest", "CASE WHEN abs(interest_exp) > 0 THEN abs(interest_exp) END"), ("debt", "coalesce(total_debt, 0.0)"), ("net_debt", "debt - coalesce(cash, 0.0)"), ("net_cash", "coalesce(net_debt < 0, false)"),
        ("icr", "div(ebitda, interest)"), ("icr_2x", "div(ebitda, interest*2)"), ("icr_3x", "div(ebitda, interest*3)"), ("icr_down_30", "div(ebitda*0.7, interest)"),
        ("debt_ebitda", "CASE WHEN ebitda > 0 THEN div(coalesce(total_debt, 0.0), ebitda) END"), ("net_debt_equity", "CASE WHEN equity > 0 THEN div(net_debt, equity) END"),
        ("short_mix", "CASE WHEN debt > 0 THEN div(coalesce(current_debt, debt - coalesce(long_term_debt, 0.0)), debt)*100 ELSE 0.0 END"),
    ),
    "fun_30_graham_magic": (
        ("price", "div(market_cap, shares_outstanding)"), ("book", "div(equity, shares_outstanding)"), ("graham", "CASE WHEN eps > 0 AND book > 0 THEN sqrt(22.5*eps*book) ELSE 0.0 END"),
        ("upside", "CASE WHEN price > 0 AND graham > 0 THEN (div(graham, price) - 1)*100 ELSE 0.0 END"), ("ev", "market_cap + total_debt - coalesce(cash, 0)"), ("earnings_yield", "CASE WHEN ev > 0 THEN coalesce(div(operating_inc, ev)*100, 0.0) ELSE 0.0 END"),
        ("capital", "total_assets - current_liabilities - coalesce(cash, 0)"), ("roic", "CASE WHEN capital > 0 THEN coalesce(div(operating_inc*0.75, capital)*100, 0.0) ELSE 0.0 END"),
    ),
}


def derived(df: DataFrame, columns: Iterable[tuple[str, str]]) -> DataFrame:
    """df with columns of (name, expression) in place of any of these names; later ones may use earlier ones. One projection, so that long lists stay cheap to plan."""
    columns = list(columns)
    return df.drop(*[name for name, _ in columns]).select("*", *[spark(e).alias(name) for name, e in columns])


def row_score(f: DataFrame, name: str) -> DataFrame:
    """The columns of one row score beside the annual rows."""
    return derived(annual(f), ROW_SCORES[name])


#: Scores over the newest years of a company: how many years, row columns first, then aggregates, then columns of those.
#: `newest(x)` and `oldest(x)` are the values of the first and last of these years.
SPAN_SCORES: dict[str, dict] = {
    "fun_05_margin_trend": dict(years=4, row=(("gm", "div(gross_profit, revenue)*100"), ("om", "div(operating_inc, revenue)*100")), agg=(("n", "count(*)"), ("g0", "newest(gm)"), ("g9", "oldest(gm)"), ("o0", "newest(om)"), ("o9", "oldest(om)")),
                                then=(("gross_falling", "coalesce(n >= 3 AND g0 < g9 - 5, false)"), ("gross_rising", "coalesce(n >= 3 AND g0 > g9 + 2, false)"), ("operating_falling", "coalesce(n >= 3 AND o0 < o9 - 3, false)"))),
    "fun_06_cash_flow_quality": dict(years=4, row=(("ng", "CASE WHEN operating_cf < 0 THEN 1 ELSE 0 END"), ("nf", "CASE WHEN fcf < 0 THEN 1 ELSE 0 END"), ("lt", "CASE WHEN net_income > 0 AND operating_cf < net_income THEN 1 ELSE 0 END"), ("ac", "div(net_income - operating_cf, total_assets)")),
                                     agg=(("neg_cfo", "sum(ng)"), ("neg_fcf", "sum(nf)"), ("cfo_lt_ni", "sum(lt)"), ("accrual", "newest(ac)")), then=(("score", "CASE WHEN neg_cfo >= 2 THEN 2 WHEN cfo_lt_ni >= 2 THEN 4 WHEN neg_cfo = 0 AND cfo_lt_ni = 0 THEN 9 ELSE 7 END"),)),
    "fun_11_growth": dict(years=4, row=(("yoy", "CASE WHEN revenue_1 > 0 THEN (div(revenue, revenue_1) - 1)*100 END"), ("eg", "CASE WHEN eps_1 > 0 THEN (div(eps, eps_1) - 1)*100 END")),
                          agg=(("n", "count(*)"), ("r0", "newest(revenue)"), ("r9", "oldest(revenue)"), ("p0", "newest(net_income)"), ("p9", "oldest(net_income)"), ("revenue_yoy", "newest(yoy)"), ("eps_growth", "newest(eg)")),
                          then=(("revenue_cagr", "CASE WHEN n >= 2 AND r9 > 0 THEN CASE WHEN r0 > 0 THEN (pow(div(r0, r9), div(1.0, n - 1)) - 1)*100 ELSE -100.0 END END"), ("profit_cagr", "CASE WHEN n >= 2 AND p9 > 0 THEN CASE WHEN p0 > 0 THEN (pow(div(p0, p9), div(1.0, n - 1)) - 1)*100 ELSE -100.0 END END"))),
    "fun_12_loss_years": dict(years=4, row=(("ls", "CASE WHEN net_income < 0 THEN 1 ELSE 0 END"), ("cxd", "CASE WHEN depreciation IS NOT NULL THEN abs(capex) END"), ("dpd", "CASE WHEN capex IS NOT NULL THEN depreciation END"), ("un", "CASE WHEN dpd > 0 AND cxd < dpd*0.8 THEN 1 ELSE 0 END")),
                              agg=(("loss_years", "sum(ls)"), ("low", "sum(un)"), ("cx", "sum(cxd)"), ("dp", "sum(dpd)"), ("pairs", "count(dpd)")), then=(("under_investing", "CASE WHEN pairs >= 2 THEN low END"), ("capex_dep", "div(cx, dp)"))),
    "agg_28_earnings_volatility": dict(years=4, row=(("mg", "CASE WHEN revenue > 0 THEN div(net_income, revenue)*100 END"),), agg=(("n", "count(net_income)"), ("sd", "stddev_pop(net_income)"), ("mean", "avg(net_income)"), ("nm", "count(mg)"), ("sdm", "stddev_pop(mg)"), ("avm", "avg(mg)")),
                                       then=(("cv", "CASE WHEN n >= 3 THEN div(sd, abs(mean))*100 END"), ("margin_mean", "CASE WHEN nm >= 3 THEN avm END"), ("margin_sd", "CASE WHEN nm >= 3 THEN sdm END"), ("margin_cv", "div(margin_sd, abs(margin_mean))*100"), ("score", "CASE WHEN cv < 15 THEN 9 WHEN cv < 30 THEN 6 WHEN cv < 50 THEN 4 WHEN cv >= 50 THEN 2 END"))),
    "fun_16_operating_leverage": dict(years=3, row=(("dol", "div(div(ebit - ebit_1, abs(ebit_1))*100, div(revenue - revenue_1, abs(revenue_1))*100)"), ("kept", "CASE WHEN abs(dol) < 50 THEN abs(dol) END")), agg=(("avg_dol", "avg(kept)"),), then=(("score", "CASE WHEN avg_dol < 1.5 THEN 9 WHEN avg_dol < 3 THEN 6 WHEN avg_dol < 5 THEN 4 WHEN avg_dol >= 5 THEN 2 END"),)),
    "fun_09_tax_outlier": dict(years=4, row=(("tr", "div(tax, pretax_income)*100"),), agg=(("n", "count(tr)"), ("mean", "avg(tr)"), ("rates", "array_sort(collect_list(CASE WHEN tr IS NOT NULL THEN named_struct('rn', rn, 'fy', fy, 'tr', tr) END))")),
                               then=(("odd", "filter(rates, x -> n >= 3 AND abs(x.tr - mean) > 10)"), ("outlier_year", "get(odd, 0).fy"), ("outlier", "size(odd) > 0"))),
    "fun_21_capital_allocation": dict(years=5, row=(("ic", "total_assets - current_liabilities - coalesce(cash, 0)"), ("ic1", "CASE WHEN rn < 5 THEN total_assets_1 - current_liabilities_1 - coalesce(cash_1, 0) END"), ("rc", "div(operating_inc*(1 - least(greatest(coalesce(div(tax, pretax_income), 0.25), 0.15), 0.35)), ic)*100"), ("inc", "div(operating_inc - operating_inc_1, ic - ic1)*100"),
                                                    ("ri", "CASE WHEN operating_inc > 0 THEN div(coalesce(abs(capex), 0) - coalesce(abs(depreciation), 0), operating_inc*0.75)*100 ELSE 0.0 END")),
                                      agg=(("avg_roce", "coalesce(avg(rc), 0.0)"), ("incremental_roce", "CASE WHEN count(*) > 1 THEN coalesce(avg(inc), 0.0) END"), ("reinvestment", "newest(ri)"), ("high_years", "count(CASE WHEN rc > 15 THEN 1 END)")), then=()),
    "fun_22_revenue_margin": dict(years=5, row=(("em", "div(ebitda, revenue)*100"), ("gm", "div(gross_profit, revenue)*100"), ("pm", "div(net_income, revenue)*100"), ("ern", "CASE WHEN em IS NOT NULL THEN rn END")),
                                  agg=(("n", "count(*)"), ("r0", "newest(revenue)"), ("r3", "max_by(revenue, CASE WHEN rn <= 4 THEN rn END)"), ("r9", "oldest(revenue)"), ("p0", "newest(net_income)"), ("p3", "max_by(net_income, CASE WHEN rn <= 4 THEN rn END)"), ("e0", "min_by(em, ern)"), ("e9", "max_by(em, ern)"), ("ne", "count(em)"), ("ng", "count(gm)"), ("gm_sd", "stddev_pop(gm)"), ("pat_margin", "newest(pm)")),
                                  then=(("revenue_cagr", "CASE WHEN n > 1 AND r0 > 0 AND r3 > 0 THEN (pow(div(r0, r3), div(1.0, least(n, 4) - 1)) - 1)*100 END"), ("revenue_cagr_5y", "CASE WHEN n >= 4 AND r0 > 0 AND r9 > 0 THEN (pow(div(r0, r9), div(1.0, n - 1)) - 1)*100 END"),
                                        ("pat_cagr", "CASE WHEN n > 1 AND p0 > 0 AND p3 > 0 THEN (pow(div(p0, p3), div(1.0, least(n, 4) - 1)) - 1)*100 END"), ("trend", "CASE WHEN ne >= 3 AND e0 > e9 + 2 THEN 'expanding' WHEN ne >= 3 AND e0 < e9 - 2 THEN 'contracting' ELSE 'stable' END"))),
    "fun_23_working_capital_trend": dict(years=5, row=(("so", "CASE WHEN revenue > 0 THEN div(receivables, revenue)*365 END"), ("io", "CASE WHEN cogs > 0 THEN div(inventory, cogs)*365 END"), ("po", "CASE WHEN cogs > 0 THEN div(payables, cogs)*365 END"), ("ccc", "so + io - po"), ("crn", "CASE WHEN ccc IS NOT NULL THEN rn END")),
                                         agg=(("n", "count(ccc)"), ("dso", "newest(so)"), ("dio", "newest(io)"), ("dpo", "newest(po)"), ("c0", "min_by(ccc, crn)"), ("c9", "max_by(ccc, crn)")), then=(("trend", "CASE WHEN n >= 3 AND c0 < c9 - 5 THEN 'improving' WHEN n >= 3 AND c0 > c9 + 10 THEN 'deteriorating' ELSE 'stable' END"),)),
    "fun_24_earnings_quality": dict(years=4, row=(("cp", "div(operating_cf, net_income)"), ("ac", "div(net_income - operating_cf, coalesce((total_assets + total_assets_1)/2, total_assets))"), ("dv", "(div(receivables - receivables_1, abs(receivables_1)) - div(revenue - revenue_1, abs(revenue_1)))*100"), ("cd", "CASE WHEN abs(depreciation) > 0 THEN div(coalesce(abs(capex), 0), abs(depreciation)) END")),
                                    agg=(("avg_cfo_pat", "coalesce(avg(cp), 0.0)"), ("avg_accrual", "coalesce(avg(ac), 0.0)"), ("divergence", "newest(dv)"), ("capex_dep", "newest(cd)")), then=()),
    "fun_26_dividends": dict(years=5, row=(("dv", "coalesce(abs(dividends_paid), 0.0)"), ("po", "CASE WHEN net_income > 0 THEN div(dv, net_income)*100 ELSE 0.0 END")), agg=(("n", "count(*)"), ("paid_years", "count(CASE WHEN dv > 0 THEN 1 END)"), ("avg_payout", "avg(po)")), then=(("consistent", "paid_years >= n - 1"),)),
    "fun_31_capex_cycle": dict(years=5, row=(("cx", "coalesce(abs(capex), 0.0)"), ("ci", "CASE WHEN revenue > 0 THEN div(cx, revenue)*100 ELSE 0.0 END"), ("atn", "div(revenue, total_assets)"), ("arn", "CASE WHEN atn IS NOT NULL THEN rn END"), ("dp", "coalesce(abs(depreciation), 0.0)")),
                               agg=(("intensity", "newest(ci)"), ("capex_now", "newest(cx)"), ("maintenance", "newest(dp)"), ("na", "count(atn)"), ("a0", "min_by(atn, arn)"), ("a9", "max_by(atn, arn)")),
                               then=(("growth_capex", "greatest(0.0, capex_now - maintenance)"), ("growth_capex_pct", "CASE WHEN capex_now > 0 THEN div(growth_capex, capex_now)*100 ELSE 0.0 END"), ("turnover", "CASE WHEN na >= 3 AND a0 > a9 + 0.1 THEN 'improving' WHEN na >= 3 AND a0 < a9 - 0.1 THEN 'deteriorating' ELSE 'stable' END"))),
    "fun_32_tax": dict(years=5, row=(("tr", "CASE WHEN pretax_income > 0 THEN div(tax, pretax_income) END"), ("ok", "CASE WHEN tr > 0 AND tr < 0.5 THEN tr END")), agg=(("avg_rate", "coalesce(avg(ok), 0.0)*100"), ("latest", "coalesce(newest(tr), 0.0)*100")), then=(("gap", "25.2 - avg_rate"), ("benefit", "gap > 5"))),
}

#: Scores over the newest quarters of a company, as SPAN_SCORES; quarters go by `rn`, the newest is 1.
QUARTER_SCORES: dict[str, dict] = {
    "fun_10_quarter_drops": dict(years=2, row=(), agg=(("r0", "newest(revenue)"), ("r1", "max(CASE WHEN rn = 2 THEN revenue END)"), ("p0", "newest(net_income)"), ("p1", "max(CASE WHEN rn = 2 THEN net_income END)")),
                                 then=(("revenue_change", "CASE WHEN r1 > 0 THEN (div(r0, r1) - 1)*100 END"), ("income_change", "CASE WHEN p1 > 0 THEN (div(p0, p1) - 1)*100 END"), ("revenue_drop", "coalesce(revenue_change < -20, false)"), ("income_drop", "coalesce(income_change < -30, false)"))),
    "win_33_momentum": dict(years=8, row=(("q", "div(revenue - revenue_1, abs(revenue_1))*100"), ("em", "div(ebitda, revenue)*100")), agg=(("n", "count(*)"), ("q0", "newest(q)"), ("q1", "max(CASE WHEN rn = 2 THEN q END)"), ("r0", "newest(revenue)"), ("r4", "max(CASE WHEN rn = 5 THEN revenue END)"), ("p0", "newest(net_income)"), ("p4", "max(CASE WHEN rn = 5 THEN net_income END)"), ("ebitda_margin", "newest(em)")),
                            then=(("revenue_yoy", "div(r0 - r4, abs(r4))*100"), ("profit_yoy", "div(p0 - p4, abs(p4))*100"), ("acceleration", "CASE WHEN q0 > q1 + 3 THEN 'accelerating' WHEN q0 < q1 - 3 THEN 'decelerating' ELSE 'stable' END"))),
}


def quarterly(q: DataFrame) -> DataFrame:
    """q(symbol, quarter_end, items) with the quarter before's items as x_1 and the place counted from the newest."""
    w = Window.partitionBy("symbol").orderBy("quarter_end")
    items = [c for c in ITEMS if c in q.columns]
    return q.select("*", *[F.lag(c).over(w).alias(f"{c}_1") for c in items], F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("quarter_end"))).alias("rn"))


def quarter_score(q: DataFrame, name: str) -> DataFrame:
    """One row per company: a score over its newest quarters."""
    return _spans(quarterly(q), {"": QUARTER_SCORES[name]})


def newest_quarter_known(annual_rows: DataFrame, q: DataFrame, at: str = "known_on") -> DataFrame:
    """annual_rows(symbol, known_on, ...) with the newest quarter of q that had ended by then: quarter_end and q_ before its items; null where there is none.

    Both are folded into one time line of each company and the last quarter is carried forward, so the join is one exchange by symbol.
    """
    items = [c for c in ITEMS if c in q.columns]
    rows = annual_rows.withColumn("__q", F.lit(None).cast(f"struct<quarter_end:date,{','.join(f'{c}:double' for c in items)}>")).withColumn("__at", F.col(at))
    marks = q.select("symbol", F.col("quarter_end").alias("__at"), F.struct("quarter_end", *[F.col(c).cast("double").alias(c) for c in items]).alias("__q"))
    both = rows.withColumn("__row", F.lit(True)).unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy("symbol").orderBy("__at", F.coalesce("__row", F.lit(False))).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__q", F.last("__q", True).over(w)).where("__row")
    return out.select(*annual_rows.columns, "__q.quarter_end", *[F.col(f"__q.{c}").alias(f"q_{c}") for c in items])


def span_score(f: DataFrame, name: str) -> DataFrame:
    """One row per company: a score over its newest years."""
    return _spans(annual(f), {"": SPAN_SCORES[name]})


def _spans(rows: DataFrame, specs: dict[str, dict], more: tuple[Column, ...] = ()) -> DataFrame:
    """One row per company with the columns of all specs, each name behind its spec's prefix: one pass over the rows, one aggregation."""
    aggregates, after = list(more), []
    x = rows.where(F.col("rn") <= max(spec["years"] for spec in specs.values()))
    for prefix, spec in specs.items():
        own = [name for part in ("row", "agg", "then") for name, _ in spec[part]]
        scoped = lambda e, own=own, prefix=prefix: re.sub(rf"(?<![.\w'])({'|'.join(own)})(?![\w('])", rf"{prefix}\1", e) if prefix else e
        x = derived(x, [(prefix + name, scoped(e)) for name, e in spec["row"]])
        within = f" FILTER (WHERE rn <= {spec['years']})"
        for name, e in spec["agg"]:
            aggregates.append(spark(re.sub(AGGREGATE, rf"\g<0>{within}", scoped(_ends(e, "min_by({0}, rn)", "max_by({0}, rn)")))).alias(prefix + name))
        after.append([(prefix + name, scoped(e)) for name, e in spec["then"]])
    x = x.groupBy("symbol").agg(*aggregates)
    for columns in after:
        x = derived(x, columns)
    return x


#: An aggregate call in the text of a score, up to its closing bracket; brackets inside are one deep at most.
AGGREGATE = r"\b(?:min_by|max_by|count|avg|sum|max|min|stddev_pop|collect_list)\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)"


def _ends(e: str, newest: str, oldest: str) -> str:
    """newest(x) and oldest(x), wherever they stand in e, in the given forms."""
    for name, form in (("newest", newest), ("oldest", oldest)):
        e = re.sub(rf"\b{name}\((\w+)\)", lambda m, form=form: form.format(m[1]), e)
    return e


#: What the composite scores take from the annual rows, by prefix.
PROFILE = {"ca_": "fun_21_capital_allocation", "rm_": "fun_22_revenue_margin", "eq_": "fun_24_earnings_quality"}


def profile(f: DataFrame) -> DataFrame:
    """One row per company with the columns of PROFILE, the newest debt over EBITDA and what the DCF starts from, from one pass over the annual rows."""
    newest = [F.min_by(spark(dict(ROW_SCORES["fun_25_debt_stress"])["debt_ebitda"]), "rn").alias("debt_ebitda")]
    return _spans(annual(f), {prefix: SPAN_SCORES[name] for prefix, name in PROFILE.items()}, (*newest, *DCF_INPUTS()))


def capital_allocation(f: DataFrame) -> DataFrame:
    """Returns on capital over five years, on capital added within them, reinvestment, and the spread over the DCF's cost of capital (12 % where there is no DCF)."""
    p = profile(f)
    wacc = dcf_of(p).select("symbol", F.col("wacc"))
    names = ("avg_roce", "incremental_roce", "reinvestment", "high_years")
    x = p.select("symbol", *[F.col(f"ca_{c}").alias(c) for c in names]).join(wacc, "symbol", "left")
    return x.withColumn("spread", F.col("avg_roce") - F.coalesce(F.col("wacc") * 100, F.lit(12.0)))


def graham(f: DataFrame) -> DataFrame:
    """Newest year: Graham number and its upside, earnings yield, return on capital, and P/E over the profit's growth of three years."""
    x = row_score(f, "fun_30_graham_magic").where("rn = 1").join(span_score(f, "fun_22_revenue_margin").select("symbol", "pat_cagr"), "symbol")
    return x.withColumn("peg", F.when(F.col("pat_cagr") > 0, ratio(ratio("market_cap", "net_income"), "pat_cagr")))


def moat(f: DataFrame) -> DataFrame:
    """0 to 10 from returns, margin stability, growth, asset intensity and cash conversion."""
    return moat_of(profile(f))


def moat_of(p: DataFrame) -> DataFrame:
    parts = [
        "CASE WHEN ca_high_years >= 4 THEN 2 WHEN ca_high_years >= 2 THEN 1 ELSE 0 END", "CASE WHEN rm_ng < 3 THEN 0 WHEN rm_gm_sd < 3 THEN 2 WHEN rm_gm_sd < 6 THEN 1 ELSE 0 END",
        "CASE WHEN rm_revenue_cagr > 15 AND rm_trend = 'expanding' THEN 2 WHEN rm_revenue_cagr > 10 THEN 1 ELSE 0 END", "CASE WHEN eq_capex_dep < 1.5 THEN 2 WHEN eq_capex_dep < 2.5 THEN 1 ELSE 0 END", "CASE WHEN eq_avg_cfo_pat > 0.9 THEN 2 WHEN eq_avg_cfo_pat > 0.7 THEN 1 ELSE 0 END",
    ]
    return p.withColumn("moat", F.expr(" + ".join(parts))).withColumn("kind", F.expr("CASE WHEN moat >= 8 THEN 'WIDE MOAT' WHEN moat >= 6 THEN 'NARROW MOAT' WHEN moat >= 4 THEN 'EMERGING MOAT' ELSE 'NO MOAT' END"))


def DCF_INPUTS() -> tuple[Column, ...]:
    """Aggregates over the newest five years that a DCF starts from."""
    names = ("total_debt", "interest_exp", "tax", "pretax_income", "cash", "shares_outstanding", "market_cap")
    known = F.when(F.col("fcf").isNotNull(), F.col("rn"))
    return (
        F.count("fcf").alias("n"), F.count("*").alias("years"), F.min_by("fcf", "rn").alias("fcf0"), F.max_by("fcf", known).alias("fcf9"), F.avg(F.when(F.col("fcf") > 0, F.col("fcf"))).alias("mean_pos"),
        F.min_by("revenue", "rn").alias("r0"), F.max_by("revenue", F.when(F.col("rn") <= 4, F.col("rn"))).alias("r3"), *[F.min_by(c, "rn").alias(c) for c in names],
    )


def dcf(f: DataFrame, scenarios: DataFrame | None = None, terminal: float = 0.05) -> DataFrame:
    """Three-stage value per share of every company, in every scenario(name, beta): five years of growth, five of fading, then a perpetuity."""
    return dcf_of(annual(f).where("rn <= 5").groupBy("symbol").agg(*DCF_INPUTS()), scenarios, terminal)


def dcf_of(x: DataFrame, scenarios: DataFrame | None = None, terminal: float = 0.05) -> DataFrame:
    """As dcf, from rows with DCF_INPUTS. Without a growth of cash flows that of revenue counts, over three years or those there are."""
    x = x.where("n >= 2").withColumn("start", F.when(F.col("fcf0") > 0, F.col("fcf0")).otherwise(F.col("mean_pos"))).where("start > 0")
    cagr = F.when((F.col("n") >= 3) & (F.col("fcf9") > 0) & (F.col("fcf0") > 0), F.pow(ratio("fcf0", "fcf9"), ratio(F.lit(1.0), F.col("n") - 1)) - 1).otherwise(F.coalesce(F.when((F.col("r0") >= 0) & (F.col("r3") > 0), F.pow(ratio("r0", "r3"), ratio(F.lit(1.0), F.least("years", F.lit(4)) - 1)) - 1), F.lit(0.10)))
    x = x.withColumn("cagr", cagr).withColumn("g", F.least(F.greatest("cagr", F.lit(0.05)), F.lit(0.35)))
    x = x.withColumn("beta", F.lit(1.0)) if scenarios is None else x.crossJoin(F.broadcast(scenarios))  # a handful of scenarios
    tax = F.least(F.greatest(F.coalesce(ratio("tax", "pretax_income"), F.lit(0.25)), F.lit(0.15)), F.lit(0.35))
    capital = F.col("market_cap") + F.col("total_debt")
    cost_of_debt = F.when(F.col("total_debt") > 0, F.coalesce(ratio(F.abs("interest_exp"), "total_debt"), F.lit(0.08))).otherwise(0.08)
    wacc = ratio("market_cap", capital) * (0.07 + F.col("beta") * 0.06) + ratio("total_debt", capital) * cost_of_debt * (1 - tax)
    x = x.withColumn("wacc", F.greatest(wacc, F.lit(0.08)))
    x = x.withColumn("ev", present_value(F.col("start"), F.col("g"), F.col("wacc"), terminal))
    x = x.withColumn("equity_value", F.col("ev") - F.col("total_debt") + F.col("cash")).withColumn("per_share", ratio("equity_value", "shares_outstanding")).withColumn("price", ratio("market_cap", "shares_outstanding"))
    return x.withColumn("margin_of_safety", F.when(F.col("per_share") > 0, ratio(F.col("per_share") - F.col("price"), "per_share") * 100).otherwise(0.0))


def present_value(cash: Column, growth: Column, wacc: Column, terminal: float) -> Column:
    """Ten years of cash and the perpetuity after them, discounted; growth fades to `terminal` in years 6 to 10."""
    def step(acc: Column, year: Column) -> Column:
        g = F.when(year <= 5, growth).otherwise(growth - (growth - terminal) * (year - 5) / 5)
        cf = acc["cf"] * (1 + g)
        return F.struct(cf.alias("cf"), (acc["pv"] + cf / F.pow(1 + wacc, year)).alias("pv"))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(10)), F.struct(cash.cast("double").alias("cf"), F.lit(0.0).alias("pv")), step)
    return end["pv"] + end["cf"] * (1 + terminal) / (wacc - terminal) / F.pow(1 + wacc, F.lit(10))


def reverse_dcf(valued: DataFrame, terminal: float = 0.05, steps: int = 50) -> DataFrame:
    """The growth at which the market's value is the discounted one, by halving -10 to 60 % a fixed number of times."""
    market = F.col("price") * F.col("shares_outstanding") + F.col("total_debt") - F.col("cash")

    def halve(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        low = present_value(F.col("start"), mid, F.col("wacc"), terminal) < market
        return F.struct(F.when(low, mid).otherwise(acc["lo"]).alias("lo"), F.when(low, acc["hi"]).otherwise(mid).alias("hi"))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(-0.10).alias("lo"), F.lit(0.60).alias("hi")), halve)
    return valued.withColumn("implied", (end["lo"] + end["hi"]) / 2).withColumn("premium", F.col("implied") - F.col("cagr"))


#: Weights of the overall score by technique.
WEIGHTS = {"beneish": 0.10, "montier": 0.08, "benford": 0.07, "altman": 0.08, "springate": 0.06, "ohlson": 0.06, "piotroski": 0.10, "cashflow": 0.10, "debt": 0.08, "profitability": 0.07, "working_capital": 0.06, "volatility": 0.05, "op_leverage": 0.04, "sgr": 0.05}
ROW_TECHNIQUES = {"beneish": "fun_01_beneish_m", "montier": "fun_13_montier_c", "altman": "fun_02_altman_z", "springate": "fun_17_springate_s", "ohlson": "fun_14_ohlson_o", "piotroski": "fun_03_piotroski_f", "debt": "fun_08_leverage", "profitability": "fun_05_margins", "working_capital": "fun_07_working_capital_days", "sgr": "fun_15_sustainable_growth"}
SPAN_TECHNIQUES = {"cashflow": "fun_06_cash_flow_quality", "volatility": "agg_28_earnings_volatility", "op_leverage": "fun_16_operating_leverage"}


def technique_scores(f: DataFrame) -> DataFrame:
    """Long table (symbol, technique, score) of the newest year, from one pass over the annual rows."""
    rows = annual(f)
    for technique, name in ROW_TECHNIQUES.items():
        rows = derived(rows, ROW_SCORES[name]).withColumnRenamed("score", f"t_{technique}")
    newest = tuple(F.min_by(f"t_{k}", "rn").cast("double").alias(f"t_{k}") for k in ROW_TECHNIQUES)
    out = _spans(rows, {f"{k}_": SPAN_SCORES[name] for k, name in SPAN_TECHNIQUES.items()}, newest)
    columns = [f"t_{k}" for k in (*ROW_TECHNIQUES, *SPAN_TECHNIQUES)]
    out = out.withColumns({f"t_{k}": F.col(f"{k}_score").cast("double") for k in SPAN_TECHNIQUES}).select("symbol", *columns).join(first_digit_score(f), "symbol", "left")
    long = out.unpivot("symbol", [*columns, "t_benford"], "technique", "score").where("score is not null")
    return long.withColumn("technique", F.regexp_replace("technique", "^t_", ""))


def digit_conformity(f: DataFrame) -> DataFrame:
    """symbol, conformity of the first digits of all items of all years; companies with too few values have no row."""
    items = [c for c in ITEMS if c in f.columns]
    values = f.select("symbol", *[F.col(c).cast("double") for c in items]).unpivot("symbol", items, "item", "value")
    return benford(values, "symbol", "value").select(F.col("key").alias("symbol"), "conformity")


def first_digit_score(f: DataFrame) -> DataFrame:
    """symbol, t_benford: 9, 5 or 2 by digit_conformity."""
    score = F.when(F.col("conformity") == "PASS", 9.0).when(F.col("conformity") == "MARGINAL", 5.0).otherwise(2.0)
    return digit_conformity(f).select("symbol", score.alias("t_benford"))


def overall(scores: DataFrame, flags: DataFrame) -> DataFrame:
    """Re-normalised weighted mean times ten, less 6, 3 or 1.5 a red flag, plus 1.5 a green one (10 at most), within 0 to 100."""
    weight = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    base = scores.withColumn("w", weight[F.col("technique")]).where("w is not null").groupBy("symbol").agg((ratio(F.sum(F.col("score") * F.col("w")), F.sum("w")) * 10).alias("base"))
    cost = F.sum(F.when(F.col("severity") == "critical", 6.0).when(F.col("severity") == "major", 3.0).when(F.col("severity") == "minor", 1.5).otherwise(0.0))
    f = flags.groupBy("symbol").agg(cost.alias("penalty"), F.least(F.count_if(F.col("severity") == "green") * 1.5, F.lit(10.0)).alias("bonus"))
    x = base.join(f, "symbol", "left").fillna(0.0, ["penalty", "bonus"])
    x = x.withColumn("final", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("base") - F.col("penalty") + F.col("bonus"))))
    return x.withColumn("label", F.when(F.col("final") >= 75, "STRONG BUY").when(F.col("final") >= 60, "BUY").when(F.col("final") >= 45, "HOLD").when(F.col("final") >= 30, "SELL / AVOID").otherwise("STRONG AVOID"))


#: Row scores and spans that the rules look at, the spans by prefix.
RULE_ROWS = ("fun_01_beneish_m", "fun_02_altman_z", "fun_03_piotroski_f", "fun_13_montier_c", "fun_14_ohlson_o", "fun_17_springate_s", "fun_08_leverage", "fun_07_working_capital_days", "fun_12_forensic_checks", "fun_15_sustainable_growth")
RULE_SPANS = {
    "mt_": SPAN_SCORES["fun_05_margin_trend"], "cf_": SPAN_SCORES["fun_06_cash_flow_quality"], "gr_": SPAN_SCORES["fun_11_growth"], "ly_": SPAN_SCORES["fun_12_loss_years"], "ev_": SPAN_SCORES["agg_28_earnings_volatility"],
    "ol_": SPAN_SCORES["fun_16_operating_leverage"], "tx_": SPAN_SCORES["fun_09_tax_outlier"],
    "re_": dict(years=4, row=(("roe", "div(net_income, equity)*100"),), agg=(("n", "count(*)"), ("now", "newest(roe)"), ("old", "oldest(roe)")), then=()),
}
# The rules of the overall score, in the order in which the techniques are run: name, severity, condition.
FLAGS = (
    ("manipulation", "critical", "m_score > -1.78"), ("no_manipulation", "green", "m_score <= -1.78"),
    ("distress", "critical", "z_score < 1.81"), ("grey_zone", "minor", "z_score >= 1.81 AND z_score < 2.99"), ("safe_zone", "green", "z_score >= 2.99"),
    ("weak_f", "major", "f_score <= 3"), ("strong_f", "green", "f_score >= 7"),
    ("gross_margin_fell", "major", "mt_gross_falling"), ("gross_margin_rose", "green", "mt_gross_rising AND NOT mt_gross_falling"), ("operating_margin_fell", "minor", "mt_operating_falling"),
    ("negative_cfo", "critical", "cf_neg_cfo >= 2"), ("positive_cfo", "green", "cf_neg_cfo = 0"), ("negative_fcf", "major", "cf_neg_fcf >= 3"), ("positive_fcf", "green", "cf_neg_fcf = 0"),
    ("cfo_below_income", "major", "cf_cfo_lt_ni >= 2"), ("cfo_above_income", "green", "cf_cfo_lt_ni = 0"), ("high_accrual", "minor", "abs(cf_accrual) > 0.10"),
    ("dso_surge", "major", "dso_surge"), ("dio_surge", "major", "dio_surge"), ("stuffing", "major", "stuffing"), ("illiquid", "major", "current_ratio < 1.0"),
    ("very_high_leverage", "critical", "de > 3.0"), ("leverage", "major", "de > 2.0 AND de <= 3.0"), ("low_debt", "green", "de < 0.5"), ("thin_coverage", "critical", "coverage < 1.5"), ("strong_coverage", "green", "coverage > 5"),
    ("leverage_rose", "minor", "de > div(total_debt_1, equity_1)*1.3"), ("leverage_fell", "green", "de <= div(total_debt_1, equity_1)*1.3 AND de < div(total_debt_1, equity_1)*0.8"),
    ("strong_roe", "green", "re_n >= 2 AND re_old IS NOT NULL AND re_now > 15"), ("roe_fell", "major", "re_n >= 2 AND re_now < 8 AND re_old > 12"), ("odd_tax_rate", "minor", "tx_outlier"),
    ("quarter_revenue_drop", "minor", "revenue_drop"), ("quarter_income_drop", "minor", "income_drop"),
    ("strong_growth", "green", "gr_revenue_cagr > 15"), ("shrinking", "major", "gr_revenue_cagr < 0"), ("strong_profit_growth", "green", "gr_profit_cagr > 20"), ("profit_shrinking", "major", "gr_profit_cagr < -10"),
    ("negative_equity", "critical", "negative_equity"), ("losses", "critical", "ly_loss_years >= 3"), ("some_losses", "major", "ly_loss_years = 2"), ("no_losses", "green", "ly_loss_years = 0"),
    ("very_high_intangibles", "critical", "intangible_ratio > 50"), ("high_intangibles", "major", "intangible_ratio > 30 AND intangible_ratio <= 50"), ("low_intangibles", "green", "intangible_ratio < 5"),
    ("dividend_above_fcf", "major", "payout_fcf > 100"), ("dividend_near_income", "minor", "coalesce(payout_fcf, 0) <= 100 AND payout_income > 90"), ("dividend_covered", "green", "payout_fcf < 60 AND coalesce(payout_income, 0) <= 90"),
    ("under_investing", "major", "ly_pairs >= 2 AND ly_under_investing >= 2"), ("investing", "green", "ly_pairs >= 2 AND ly_under_investing = 0 AND ly_capex_dep > 1.5"),
    ("strong_conversion", "green", "cash_conversion > 80"), ("weak_conversion", "minor", "cash_conversion > 0 AND cash_conversion < 30"), ("strong_roic", "green", "roic > 15"), ("low_roic", "minor", "roic < 5"),
    ("low_quick_ratio", "minor", "quick_ratio < 0.8"), ("strong_quick_ratio", "green", "quick_ratio > 1.5"),
    ("digits_fail", "critical", "conformity = 'FAIL'"), ("digits_marginal", "minor", "conformity = 'MARGINAL'"), ("digits_pass", "green", "conformity = 'PASS'"),
    ("montier_high", "critical", "c_score >= 4"), ("montier_moderate", "minor", "c_score BETWEEN 2 AND 3"), ("montier_low", "green", "c_score < 2"),
    ("bankruptcy_likely", "critical", "probability > 0.5"), ("bankruptcy_possible", "minor", "probability > 0.3 AND probability <= 0.5"), ("bankruptcy_unlikely", "green", "probability <= 0.3"),
    ("growth_far_too_fast", "major", "gap > 10"), ("growth_too_fast", "minor", "gap > 5 AND gap <= 10"), ("growth_sustainable", "green", "gap <= 5 AND sgr > 15 AND growth > 0"),
    ("volatile", "major", "ev_cv > 50"), ("fairly_volatile", "minor", "ev_cv > 30 AND ev_cv <= 50"), ("stable_earnings", "green", "ev_cv < 15"),
    ("very_high_leverage_of_costs", "major", "ol_avg_dol > 5"), ("high_leverage_of_costs", "minor", "ol_avg_dol > 3 AND ol_avg_dol <= 5"), ("low_leverage_of_costs", "green", "ol_avg_dol < 1.5"),
    ("springate_distress", "critical", "s_score < 0.862"), ("springate_healthy", "green", "s_score >= 0.862"),
    ("under_surveillance", "critical", "listed"), ("not_under_surveillance", "green", "NOT listed"),
)
#: Rules of each agency's best rating by its rank, and of all filings of a company.
RATING_RULES = (("rating_high", "green", "rank >= 9"), ("rating_good", "green", "rank >= 7 AND rank < 9"), ("rating_medium", "minor", "rank >= 5 AND rank < 7"), ("rating_junk", "critical", "rank > 0 AND rank < 5"))
FILING_RULES = (("negative_outlook", "major", "negative"), ("downgraded", "major", "downgraded"))


#: Rules of the newest quarter's holdings: name, severity, condition.
PROMOTER_RULES = (
    ("low_promoter", "major", "promoter_pct < 25"), ("high_promoter", "green", "promoter_pct > 70"),
    ("pledge_very_high", "critical", "pledge_pct > 50"), ("pledge_high", "major", "pledge_pct > 20 AND pledge_pct <= 50"), ("pledge", "minor", "pledge_pct > 0 AND pledge_pct <= 20"), ("no_pledge", "green", "pledge_pct = 0"),
    ("promoter_sold", "major", "change < -3"), ("promoter_bought", "green", "change > 2"),
)


def raised(rows: DataFrame, rules: tuple[tuple[str, str, str], ...]) -> DataFrame:
    """rows with rule and severity, one row for each rule that holds; a null condition doesn't."""
    each = F.array(*[F.when(spark(c), F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"))) for n, s, c in rules])
    return rows.withColumn("__f", F.explode(F.filter(each, lambda x: x.isNotNull()))).select(*rows.columns, "__f.rule", "__f.severity")


def flag_rows(f: DataFrame, quarters: DataFrame | None = None, surveillance: DataFrame | None = None) -> DataFrame:
    """One wide row per company with everything that FLAGS look at; what is not given is null and raises nothing.

    quarters as in quarter_score; surveillance(symbol, listed). The annual rows are windowed once and aggregated once.
    """
    rows = annual(f)
    for name in RULE_ROWS:
        rows = derived(rows, ROW_SCORES[name])
    newest = [c for c in rows.columns if c != "symbol"]
    out = _spans(rows, RULE_SPANS, (F.min_by(F.struct(*newest), "rn").alias("__newest"),))
    out = out.select("symbol", "__newest.*", *[c for c in out.columns if c not in ("symbol", "__newest")]).join(digit_conformity(f), "symbol", "left")
    drops = None if quarters is None else quarter_score(quarters, "fun_10_quarter_drops").select("symbol", "revenue_drop", "income_drop")
    none = F.lit(None).cast("boolean")
    out = out.withColumns({"revenue_drop": none, "income_drop": none}) if drops is None else out.join(drops, "symbol", "left")
    return out.withColumn("listed", none) if surveillance is None else out.join(surveillance.select("symbol", "listed"), "symbol", "left")


def flags(f: DataFrame, quarters: DataFrame | None = None, surveillance: DataFrame | None = None, promoters: DataFrame | None = None, ratings: DataFrame | None = None) -> DataFrame:
    """Long table (symbol, rule, severity) of what each company raises.

    promoters(ticker, as_of, promoter_pct, pledge_pct) bring PROMOTER_RULES, ratings(symbol, agency, rank, negative, downgraded) RATING_RULES for
    each agency and FILING_RULES once a company. Only companies with annual rows are flagged.
    """
    wide = flag_rows(f, quarters, surveillance)
    out = raised(wide, FLAGS).select("symbol", "rule", "severity")
    known = f.select("symbol").distinct()
    if promoters is not None:
        out = out.unionByName(promoter_flags(promoters).select(F.col("ticker").alias("symbol"), "rule", "severity").join(known, "symbol", "left_semi"))
    if ratings is not None:
        mine = ratings.join(known, "symbol", "left_semi")
        whole = mine.groupBy("symbol").agg(F.bool_or("negative").alias("negative"), F.bool_or("downgraded").alias("downgraded"))
        out = out.unionByName(raised(mine, RATING_RULES).select("symbol", "rule", "severity")).unionByName(raised(whole, FILING_RULES).select("symbol", "rule", "severity"))
    return out


def promoter_flags(holdings: DataFrame) -> DataFrame:
    """holdings(ticker, as_of, promoter_pct, pledge_pct) to the rules that the newest row raises, with its change against the row before."""
    w = Window.partitionBy("ticker").orderBy("as_of")
    x = holdings.withColumn("change", F.col("promoter_pct") - F.lag("promoter_pct").over(w)).withColumn("rn", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("as_of"))))
    return raised(x.where("rn = 1").drop("rn"), PROMOTER_RULES)


def risk(f: DataFrame, bands: DataFrame | None = None, governance: DataFrame | None = None) -> DataFrame:
    """0 to 10: leverage (3), place in the P/E band (2), cash backing (2), governance (2) and the growth that the market expects (1).

    bands(symbol, pe_percentile) and governance(symbol, auditor_concern, high_related_party) are optional; what is null or missing adds nothing.
    """
    return risk_of(profile(f), bands, governance)


def risk_of(p: DataFrame, bands: DataFrame | None = None, governance: DataFrame | None = None) -> DataFrame:
    g = reverse_dcf(dcf_of(p)).select("symbol", "implied", "margin_of_safety")
    x = p.join(g, "symbol", "left")
    x = x.withColumn("pe_percentile", F.lit(None).cast("double")) if bands is None else x.join(bands.select("symbol", "pe_percentile"), "symbol", "left")
    none = F.lit(False)
    x = x.withColumns({"auditor_concern": none, "high_related_party": none}) if governance is None else x.join(governance.select("symbol", "auditor_concern", "high_related_party"), "symbol", "left")
    return x.withColumn("risk", F.expr(" + ".join(RISK_PARTS))).withColumn("kind", F.expr("CASE WHEN risk >= 7 THEN 'HIGH RISK' WHEN risk >= 4 THEN 'MODERATE RISK' ELSE 'LOW RISK' END"))


# Steps of the risk score.
RISK_PARTS = (
    "CASE WHEN debt_ebitda > 4 THEN 3.0 WHEN debt_ebitda > 2 THEN 1.5 ELSE 0.0 END", "CASE WHEN pe_percentile > 85 THEN 2.0 WHEN pe_percentile > 65 THEN 1.0 ELSE 0.0 END", "CASE WHEN eq_avg_cfo_pat < 0.5 THEN 2.0 WHEN eq_avg_cfo_pat < 0.7 THEN 1.0 ELSE 0.0 END",
    "CASE WHEN auditor_concern THEN 1.0 ELSE 0.0 END", "CASE WHEN high_related_party THEN 1.0 ELSE 0.0 END", "CASE WHEN implied > 0.30 THEN 1.0 ELSE 0.0 END",
)


#: What may adjust the deep score, all of it optional.
ADJUSTMENTS = {"alpha": "double", "insider": "string", "promoter": "string", "trajectory": "string", "institutional_pct": "double", "n_funds": "long", "trend": "string", "pe_percentile": "double"}


def deep(f: DataFrame, adjustments: DataFrame, quarters: DataFrame | None = None, governance: DataFrame | None = None) -> DataFrame:
    """0 to 100: valuation and quality 25 % each, growth 20 %, earnings quality and risk 15 % each, and at most ten points for what adjusts it.

    adjustments(symbol, and any columns of ADJUSTMENTS): mean alpha, net insider sentiment (BULLISH, BEARISH), promoter trend (increasing,
    decreasing), rating trajectory (UPGRADED, DOWNGRADED), percent held by institutions, number of funds, technical trend, and the place in
    the P/E band, which counts for the risk too. quarters give the growth's acceleration, governance is that of risk(). What is null or
    missing adjusts nothing. The annual rows are read once for all components.
    """
    known = adjustments.select("symbol", *[(F.col(c) if c in adjustments.columns else F.lit(None)).cast(kind).alias(c) for c, kind in ADJUSTMENTS.items()])
    x = risk_of(moat_of(profile(f)).drop("kind"), known, governance).drop("pe_percentile", "kind").withColumnsRenamed({"rm_revenue_cagr": "revenue_cagr", "eq_avg_cfo_pat": "avg_cfo_pat", "eq_avg_accrual": "avg_accrual"})
    pace = None if quarters is None else quarter_score(quarters, "win_33_momentum").select("symbol", "acceleration")
    x = x.withColumn("acceleration", F.lit("stable")) if pace is None else x.join(pace, "symbol", "left")
    x = x.join(known, "symbol", "left")
    return derived(x, DEEP)


# Steps of the components and points of the adjustments.
DEEP = (
    ("priced", "CASE WHEN margin_of_safety IS NULL THEN 50 WHEN margin_of_safety > 40 THEN 90 WHEN margin_of_safety > 20 THEN 75 WHEN margin_of_safety > 0 THEN 60 WHEN margin_of_safety > -20 THEN 40 WHEN margin_of_safety > -40 THEN 25 ELSE 10 END"),
    ("valuation", "CASE WHEN pe_percentile IS NULL THEN CAST(priced AS DOUBLE) ELSE least(100.0, priced + (100 - pe_percentile) / 100 * 20) END"),
    ("growth", "least(100, greatest(0, CASE WHEN coalesce(revenue_cagr, 0) > 25 THEN 85 WHEN coalesce(revenue_cagr, 0) > 15 THEN 70 WHEN coalesce(revenue_cagr, 0) > 8 THEN 55 WHEN coalesce(revenue_cagr, 0) > 0 THEN 40 ELSE 20 END + CASE acceleration WHEN 'accelerating' THEN 10 WHEN 'decelerating' THEN -10 ELSE 0 END))"),
    ("earnings", "greatest(0, CASE WHEN avg_cfo_pat > 1.0 THEN 85 WHEN avg_cfo_pat > 0.8 THEN 70 WHEN avg_cfo_pat > 0.6 THEN 50 ELSE 25 END - CASE WHEN avg_accrual > 0.10 THEN 15 ELSE 0 END)"),
    ("bonus", "greatest(-10, least(10, CASE insider WHEN 'BULLISH' THEN 3 WHEN 'BEARISH' THEN -3 ELSE 0 END + CASE promoter WHEN 'increasing' THEN 2 WHEN 'decreasing' THEN -2 ELSE 0 END"
              " + CASE WHEN alpha > 15 THEN 2 WHEN alpha < -15 THEN -2 ELSE 0 END + CASE trajectory WHEN 'UPGRADED' THEN 2 WHEN 'DOWNGRADED' THEN -3 ELSE 0 END"
              " + CASE WHEN institutional_pct > 30 THEN 1 ELSE 0 END + CASE WHEN n_funds > 10 THEN 1 ELSE 0 END + CASE trend WHEN 'STRONG UPTREND' THEN 2 WHEN 'DOWNTREND' THEN -2 ELSE 0 END))"),
    ("final", "greatest(0.0, least(100.0, 0.25*valuation + 0.25*moat*10 + 0.20*growth + 0.15*earnings + 0.15*greatest(0, (10 - risk)*10) + bonus))"),
    ("label", "CASE WHEN final >= 75 THEN 'STRONG BUY' WHEN final >= 60 THEN 'BUY' WHEN final >= 45 THEN 'HOLD' WHEN final >= 30 THEN 'REDUCE' ELSE 'SELL' END"),
)


def comparison_sheet(f: DataFrame, bars: DataFrame, betas: DataFrame, holders: DataFrame) -> DataFrame:
    """One row per company with what two companies are compared by: size, multiples, returns, margins, growth, debt, holders and prices.

    betas(symbol, beta), holders(symbol, promoter_pct, pledged_pct). Forward earnings aren't known here: forward_pe is the price over last
    earnings grown by their last growth. A ratio without its parts is null.
    """
    w = Window.partitionBy("symbol").orderBy("fy")
    old = {f"{c}_3": F.lag(c, 3).over(w) for c in ("revenue", "net_income")}
    x = annual(f).withColumns(old).where("rn = 1")
    pct = lambda a, b: ratio(a, b) * 100
    c = F.col
    growth = lambda name: F.when(c(f"{name}_1") > 0, (ratio(name, f"{name}_1") - 1) * 100)
    cagr = lambda name: F.when((c(name) > 0) & (c(f"{name}_3") > 0), (F.pow(ratio(name, f"{name}_3"), F.lit(1 / 3)) - 1) * 100)
    employed = c("total_assets") - c("current_liabilities")
    x = x.withColumns({
        "market_cap_cr": c("market_cap") / 1e7, "trailing_pe": ratio("market_cap", "net_income"), "pb": ratio("market_cap", "equity"), "ps": ratio("market_cap", "revenue"),
        "ev_ebitda": ratio(c("market_cap") + c("total_debt") - c("cash"), "ebitda"), "div_yield_pct": pct(-c("dividends_paid"), "market_cap"),
        "roe_pct": pct("net_income", "equity"), "roa_pct": pct("net_income", "total_assets"), "roce_pct": F.when(employed > 0, pct("ebit", employed)), "opm_pct": pct("operating_inc", "revenue"), "npm_pct": pct("net_income", "revenue"),
        "rev_growth_pct": growth("revenue"), "earn_growth_pct": growth("net_income"), "rev_cagr_3y_pct": cagr("revenue"), "pat_cagr_3y_pct": cagr("net_income"),
        "de_ratio": ratio("total_debt", "equity"), "current_ratio": ratio("current_assets", "current_liabilities"), "interest_coverage": F.when(F.abs("interest_exp") > 0, ratio("ebit", F.abs("interest_exp"))),
    })
    x = x.withColumn("forward_pe", ratio("trailing_pe", 1 + c("earn_growth_pct") / 100))
    year = Window.partitionBy("symbol").orderBy(F.desc("date"))
    p = bars.withColumn("rn", F.row_number().over(year)).where("rn <= 252").groupBy("symbol").agg(
        F.min_by("close", "rn").alias("cmp"), F.max("high").alias("high_52w"), F.min("low").alias("low_52w"),
        F.when(F.count("*") > 20, (ratio(F.min_by("close", "rn"), F.max_by("close", "rn")) - 1) * 100).alias("return_1y_pct"),
    )
    out = x.join(p, "symbol", "left").join(betas.select("symbol", "beta"), "symbol", "left").join(holders.select("symbol", "promoter_pct", "pledged_pct"), "symbol", "left")
    return out.select("symbol", *COMPARED)


COMPARED = (
    "market_cap_cr", "trailing_pe", "forward_pe", "pb", "ev_ebitda", "ps", "div_yield_pct", "roe_pct", "roa_pct", "roce_pct", "opm_pct", "npm_pct", "eps", "rev_growth_pct", "earn_growth_pct",
    "rev_cagr_3y_pct", "pat_cagr_3y_pct", "de_ratio", "current_ratio", "interest_coverage", "promoter_pct", "pledged_pct", "cmp", "high_52w", "low_52w", "return_1y_pct", "beta",
)


def benford(values: DataFrame, key: str, value: str, least: int = 50) -> DataFrame:
    """First digits against log10(1 + 1/d): chi-square (15.507 and 20.09), mean absolute deviation in points, verdict; keys with fewer values are left out."""
    digit = F.regexp_extract(F.format_string("%.10e", F.abs(F.col(value).cast("double"))), "[1-9]", 0).cast("int")
    counts = values.where(F.col(value).isNotNull() & (F.col(value) != 0)).groupBy(F.col(key).alias("key"), digit.alias("d")).agg(F.count("*").alias("n"))
    wide = counts.groupBy("key").agg(F.sum("n").alias("total"), *[F.coalesce(F.sum(F.when(F.col("d") == d, F.col("n"))), F.lit(0)).alias(f"n{d}") for d in range(1, 10)]).where(F.col("total") >= least)
    share = lambda d: F.log10(F.lit(1 + 1 / d))
    chi = sum(F.pow(F.col(f"n{d}") - share(d) * F.col("total"), F.lit(2)) / (share(d) * F.col("total")) for d in range(1, 10))
    mad = sum(F.abs(F.col(f"n{d}") / F.col("total") - share(d)) * 100 for d in range(1, 10)) / 9
    return wide.select("key", "total", chi.alias("chi_square"), mad.alias("mad")).withColumn("conformity", F.when(F.col("chi_square") > 20.09, "FAIL").when(F.col("chi_square") > 15.507, "MARGINAL").otherwise("PASS"))


def best_source(candidates: DataFrame) -> DataFrame:
    """Per company the source with most years, then with info, then with most price rows; ties by name."""
    return candidates.groupBy("symbol").agg(F.min_by("source", F.struct(-F.col("years"), ~F.col("has_info"), -F.col("price_rows"), "source")).alias("source"))


def peer_comparison(companies: DataFrame) -> DataFrame:
    """companies(symbol, sector, pe, pb) against the mean of the positive values of the other companies of their sector.

    Sums by sector are combined before their exchange and joined back, so few sectors don't mean few tasks.
    """
    positive = {m: F.when(F.col(m) > 0, F.col(m)) for m in ("pe", "pb")}
    sums = companies.groupBy("sector").agg(*[f(v).alias(f"{n}_{m}") for m, v in positive.items() for n, f in (("sum", F.sum), ("n", F.count))])
    out = companies.join(sums, "sector")
    for m, pos in positive.items():
        others = ratio(F.col(f"sum_{m}") - F.coalesce(pos, F.lit(0.0)), F.col(f"n_{m}") - F.when(pos.isNotNull(), 1).otherwise(0))
        out = out.withColumn(f"peer_{m}", others).withColumn(f"{m}_discount", (1 - ratio(m, F.col(f"peer_{m}"))) * 100)
    return out
