from oracle.ctes import build

FLOWS = ["projected_revenue", "projected_ebit", "nopat", "da", "projected_capex", "change_in_nwc", "fcf"]
DCF = ["terminal_value", "pv_explicit_fcf", "pv_terminal_value", "enterprise_value", "equity_value", "market_enterprise_value"]
FACTS = ["revenue", "ebit", "pretax", "tax_provision", "interest", "total_debt", "cash", "equity", "ocf", "capex"]

ASSUMED = """
SELECT *, coalesce(growth_hist, 0.08e0) AS growth, coalesce(margin_hist, 0.15e0) AS margin, coalesce(tax_derived, 0.21e0) AS tax_rate
FROM inputs_at"""
PROJECTED = f"""
SELECT ticker, as_of, y::INTEGER AS year, tax_rate, r AS projected_revenue, r * margin AS projected_ebit, r * margin * (1 - tax_rate) AS nopat,
  r * 0.03e0 AS da, r * 0.04e0 AS projected_capex, (r - r0) * 0.01e0 AS change_in_nwc,
  r * margin * (1 - tax_rate) + r * 0.03e0 - r * 0.04e0 - (r - r0) * 0.01e0 AS fcf
FROM (SELECT *, revenue * pow(1 + growth, y) AS r, revenue * pow(1 + growth, y - 1) AS r0 FROM ({ASSUMED}), years5) WHERE revenue > 0"""

GRID = """
SELECT 1 AS table_no, i - 1 AS pos, [0.05e0, 0.075e0, 0.1e0, 0.125e0, 0.15e0, 0.175e0, 0.2e0][i] AS sw, NULL::DOUBLE AS st, NULL::DOUBLE AS sg, NULL::DOUBLE AS sm FROM range(1, 8) AS r(i)
UNION ALL SELECT 2, i - 1, NULL, [0e0, 0.01e0, 0.02e0, 0.025e0, 0.03e0, 0.04e0, 0.05e0][i], NULL, NULL FROM range(1, 8) AS r(i)
UNION ALL SELECT 3, i - 1, NULL, NULL, [-0.1e0, -0.05e0, 0e0, 0.05e0, 0.1e0, 0.2e0, 0.3e0, 0.4e0][i], NULL FROM range(1, 9) AS r(i)
UNION ALL SELECT 4, i - 1, NULL, NULL, NULL, [0e0, 0.1e0, 0.2e0, 0.3e0, 0.4e0, 0.5e0, 0.6e0][i] FROM range(1, 8) AS r(i)
UNION ALL SELECT 5, (i - 1) * 6 + j - 1, [0.05e0, 0.08e0, 0.11e0, 0.14e0, 0.17e0, 0.2e0][i], [0e0, 0.01e0, 0.02e0, 0.03e0, 0.04e0, 0.05e0][j], NULL, NULL
  FROM range(1, 7) AS r(i), range(1, 7) AS q(j)"""

CELLS = f"""
SELECT ticker, as_of, table_no, pos, x_wacc, x_terminal, x_growth, x_margin, f1 AS fcf_1, f2 AS fcf_2, f3 AS fcf_3, f4 AS fcf_4, f5 AS fcf_5,
  tv AS terminal_value, ev AS enterprise_value, ev - coalesce(total_debt, 0) + coalesce(cash, 0) AS equity_value,
  (ev - coalesce(total_debt, 0) + coalesce(cash, 0)) / shares AS intrinsic_value
FROM (SELECT *, f1 / pow(1 + x_wacc, 1) + f2 / pow(1 + x_wacc, 2) + f3 / pow(1 + x_wacc, 3) + f4 / pow(1 + x_wacc, 4) + f5 / pow(1 + x_wacc, 5)
    + tv / pow(1 + x_wacc, 5) AS ev
  FROM (SELECT *, CASE WHEN x_wacc > x_terminal THEN f5 * (1 + x_terminal) / (x_wacc - x_terminal) END AS tv
    FROM (SELECT *, {", ".join(f"revenue * pow(1 + x_growth, {y}) * (x_margin * (1 - tax_rate) + 0.03e0 - 0.04e0) - 0.01e0 * (revenue * pow(1 + x_growth, {y}) - revenue * pow(1 + x_growth, {y - 1})) AS f{y}" for y in range(1, 6))}
      FROM (SELECT w.*, table_no, pos, coalesce(sw, wacc) AS x_wacc, coalesce(st, 0.025e0) AS x_terminal, coalesce(sg, growth) AS x_growth,
          coalesce(sm, margin) AS x_margin FROM wacc_rows AS w, ({GRID}) WHERE revenue > 0 AND wacc IS NOT NULL))))"""

SENS = ["fcf_1", "fcf_2", "fcf_3", "fcf_4", "fcf_5", "terminal_value", "enterprise_value", "equity_value"]

SQL = {
    "a5_average_margin": build("SELECT ticker, as_of, margin_hist FROM margin_at", r6=["margin_hist"]),
    "a6_revenue_cagr": build("SELECT ticker, as_of, revenue_cagr FROM growth_at", r6=["revenue_cagr"]),
    "w2_fcf_growth": build("SELECT ticker, as_of, fcf_growth FROM inputs_at", r6=["fcf_growth"]),
    "x1_effective_tax": build("SELECT ticker, as_of, tax_derived FROM inputs_at", r6=["tax_derived"]),
    "x2_cost_of_debt": build("SELECT ticker, as_of, debt_cost FROM inputs_at", r6=["debt_cost"]),
    "x3_valuation_inputs": build("SELECT * EXCLUDE (income_period, balance_period, cash_flow_period) FROM inputs_at",
        r6=FACTS + ["revenue_cagr", "growth_hist", "margin_hist", "tax_derived", "debt_cost", "fcf_growth"]),
    "x4_wacc": build("SELECT ticker, as_of, wacc FROM wacc_rows", r6=["wacc"]),
    "x5_tax_precedence": build("SELECT ticker, as_of, coalesce(tax_derived, 0.21e0) AS tax_rate, 0.3e0 AS tax_override FROM inputs_at", r6=["tax_rate"]),
    "x6_cash_flow_projection": build(f"SELECT * EXCLUDE (tax_rate) FROM ({PROJECTED})", r2=FLOWS),
    "x7_terminal_value": build("SELECT ticker, as_of, terminal_value FROM dcf", r2=["terminal_value"]),
    "x8_discounting": build("SELECT ticker, as_of, pv_explicit_fcf, pv_terminal_value, enterprise_value FROM dcf",
        r2=["pv_explicit_fcf", "pv_terminal_value", "enterprise_value"]),
    "x9_equity_bridge": build("SELECT ticker, as_of, equity_value, intrinsic_value FROM dcf", r2=["equity_value"], r6=["intrinsic_value"]),
    "x10_market_enterprise_value": build("SELECT ticker, as_of, market_enterprise_value FROM dcf", r2=["market_enterprise_value"]),
    "x11_fcf_yield": build("SELECT ticker, as_of, fcf_yield FROM valued", r6=["fcf_yield"]),
    "x12_full_dcf": build(f"SELECT ticker, as_of, wacc, growth, margin, tax_rate, {', '.join(DCF)}, intrinsic_value, price, fcf_yield FROM valued",
        r2=DCF, r6=["wacc", "growth", "margin", "tax_rate", "intrinsic_value", "price", "fcf_yield"]),
    "x13_point_in_time_valuation": build("SELECT * FROM valuations", r6=["price", "intrinsic_value", "price_to_intrinsic", "wacc", "beta",
        "fcf_yield", "tax_rate", "fcf_growth", "roic"]),
    "x14_roic": build("SELECT ticker, as_of, roic FROM valued WHERE income_period IS NOT NULL", r6=["roic"]),
    "x18_altman_z": build("""
SELECT ticker, as_of, altman_z, CASE WHEN altman_z IS NULL THEN 'N/A' WHEN altman_z < 1.8e0 THEN 'Distress Zone'
  WHEN altman_z <= 2.99e0 THEN 'Grey Zone' ELSE 'Safe Zone' END AS zone FROM z_scores WHERE as_of = DATE '2001-06-30'""", r6=["altman_z"]),
    "x19_f_score": build("SELECT ticker, as_of, f_score FROM f_scores WHERE as_of = DATE '2001-06-30'", big=["f_score"]),
    "f10_altman_gate": build("""
SELECT c.ticker, coalesce(sector, '') <> 'ASIA' AND coalesce(altman_z < 1.8e0, true) AS rejected
FROM companies AS c LEFT JOIN z_scores AS z ON z.ticker = c.ticker AND z.as_of = DATE '2001-06-30'"""),
    "f17_altman_zone": build("""
SELECT event_id, CASE WHEN altman_z_score IS NULL THEN 'N/A' WHEN altman_z_score < 1.8e0 THEN 'Distress Zone'
  WHEN altman_z_score <= 2.99e0 THEN 'Grey Zone' ELSE 'Safe Zone' END AS zone FROM trade_logs"""),
    "x20_sensitivity_tables": build(f"SELECT * FROM ({CELLS}) WHERE table_no < 5", r2=SENS,
        r6=["x_wacc", "x_terminal", "x_growth", "x_margin", "intrinsic_value"]).replace("SELECT * REPLACE (", "SELECT * REPLACE (table_no::INTEGER AS table_no, pos::INTEGER AS pos, "),
    "x21_two_way_grid": build(f"SELECT ticker, as_of, x_wacc, x_terminal, intrinsic_value FROM ({CELLS}) WHERE table_no = 5", r6=["x_wacc", "x_terminal", "intrinsic_value"]),
    "x22_recovered_tax": build(f"SELECT ticker, as_of, tax_rate, 1 - nopat / nullif(projected_ebit, 0) AS implied_tax_rate FROM ({PROJECTED}) WHERE year = 1",
        r6=["tax_rate", "implied_tax_rate"]),
    "x25_risk_density": build("""
SELECT event_id, bin::INTEGER AS bin, -4e0 * s + bin * (8e0 * s / 60) AS x,
  1 / (s * sqrt(2 * pi())) * exp(-((-4e0 * s + bin * (8e0 * s / 60)) ** 2) / (2 * s * s)) AS density
FROM (SELECT event_id, abs(var_95) / 1.6448536269514722e0 AS s FROM trade_logs WHERE abs(var_95) > 0), range(61) AS r(bin)""", r6=["x", "density"]),
    "l14_captured_outputs": build(f"""
SELECT ticker, as_of, count(*) AS years, {", ".join(f"max(fcf) FILTER (year = {y}) AS fcf_{y}" for y in range(1, 6))}
FROM ({PROJECTED}) GROUP BY 1, 2""", r2=[f"fcf_{y}" for y in range(1, 6)]),
    "w4_trend_filter": build("""
SELECT ticker, count(*) AS closes, avg(close) AS sma, arg_max(close, date) AS last_close,
  count(*) = 200 AND avg(close) > 0 AND arg_max(close, date) >= avg(close) * 0.98e0 AS trend_ok
FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM company_prices WHERE date <= DATE '2001-06-30')
WHERE rn <= 200 GROUP BY ticker""", r6=["sma", "last_close"]),
}


def rsi(since: str) -> str:
    """The recursive form: seed with the mean of 14 changes, then smooth one change at a time."""
    return build(f"""
WITH RECURSIVE moves AS (SELECT * FROM (SELECT ticker, row_number() OVER w - 1 AS i, close - lag(close) OVER w AS m
    FROM company_prices WHERE date BETWEEN DATE '{since}' AND DATE '2001-06-30' WINDOW w AS (PARTITION BY ticker ORDER BY date)) WHERE i >= 1),
step AS (
  SELECT ticker, 14 AS i, avg(greatest(m, 0)) AS g, avg(greatest(-m, 0)) AS l FROM moves WHERE i <= 14 GROUP BY ticker HAVING count(*) = 14
  UNION ALL SELECT s.ticker, s.i + 1, (s.g * 13 + greatest(m.m, 0)) / 14, (s.l * 13 + greatest(-m.m, 0)) / 14
  FROM step AS s JOIN moves AS m ON m.ticker = s.ticker AND m.i = s.i + 1)
SELECT ticker, round(CASE WHEN l = 0 THEN 100e0 ELSE 100e0 - 100e0 / (1 + g / l) END, 6) + 0e0 AS rsi
FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY i DESC) AS last FROM step) WHERE last = 1""")


SQL["w5_wilder_rsi"] = rsi("2001-03-30")
SQL["w5_wilder_rsi_year"] = rsi("2000-06-30")
