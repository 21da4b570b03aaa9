from oracle.ctes import build, cte
from oracle.selection import REQUESTS

cte("inputs_now", """
SELECT i.ticker, i.revenue, b.total_debt, b.cash, CASE WHEN g.c > 0.25e0 THEN 0.25e0 ELSE g.c END AS growth_hist, g.m AS margin_hist,
  CASE WHEN i.pretax <> 0 AND i.tax_provision / i.pretax >= 0 AND i.tax_provision / i.pretax < 1 THEN i.tax_provision / i.pretax END AS tax_derived,
  abs(nullif(i.interest, 0)) / nullif(b.total_debt, 0) AS debt_cost
FROM inc_now AS i JOIN bal_now AS b ON b.ticker = i.ticker AND b.rn = 1
JOIN (SELECT ticker, avg(ebit / revenue) FILTER (revenue > 0) AS m,
    pow(arg_max(revenue, period_end) / arg_min(revenue, period_end), 1 / ((max(period_end) - min(period_end)) / 365.25e0)) - 1 AS c FROM inc GROUP BY 1) AS g
  ON g.ticker = i.ticker WHERE i.rn = 1
""")
cte("request_rows", f"""
SELECT c.ticker, coalesce(c.sector, 'Unknown') AS sector, c.beta, coalesce(nullif(last_price, 0), nullif(alt_price, 0)) AS price,
  c.shares_outstanding AS shares, c.ticker AS rid, c.universe_pos, NULL AS refused, x.* EXCLUDE (ticker), (SELECT risk_free FROM rf_at WHERE as_of = DATE '2001-06-30') AS risk_free,
  CASE WHEN c.universe_pos % 2 = 1 THEN growth_request END AS gr, CASE WHEN c.universe_pos % 2 = 1 THEN margin_request END AS mr,
  CASE WHEN c.universe_pos % 2 = 1 THEN terminal_request ELSE 0.025e0 END AS tr
FROM companies AS c JOIN ({REQUESTS}) AS r ON r.ticker = c.ticker LEFT JOIN inputs_now AS x ON x.ticker = c.ticker
""")
cte("asked_rows", """
SELECT * REPLACE (CASE WHEN gr NOT BETWEEN -0.1e0 AND 0.4e0 THEN 'growth_out_of_range' WHEN mr NOT BETWEEN 0 AND 0.6e0 THEN 'margin_out_of_range'
  WHEN tr NOT BETWEEN 0 AND 0.05e0 THEN 'terminal_growth_out_of_range' END AS refused) FROM request_rows
UNION ALL SELECT * REPLACE (ticker || ' again' AS rid, NULL AS gr, NULL AS mr, 0.025e0 AS tr) FROM request_rows WHERE universe_pos % 10 = 2
UNION ALL BY NAME SELECT 'X' || ticker AS ticker, ticker || ' x' AS rid, 'unknown_ticker' AS refused, 0.025e0 AS tr FROM request_rows WHERE universe_pos % 10 = 0
UNION ALL BY NAME SELECT '' AS ticker, ticker || ' blank' AS rid, 'invalid_ticker' AS refused, 0.025e0 AS tr FROM request_rows WHERE universe_pos % 10 = 1
""")
# Two passes over the same formula: historical assumptions (h) and requested ones (r).
for _name, _rows, _g, _m, _t in (("quoted", "request_rows", "coalesce(growth_hist, 0.08e0)", "coalesce(margin_hist, 0.15e0)", "0.025e0"),
                          ("asked", "asked_rows", "coalesce(gr, growth_hist, 0.08e0)", "coalesce(mr, margin_hist, 0.15e0)", "tr")):
    cte(f"{_name}_rates", f"""
SELECT *, {_g} AS growth, {_m} AS margin, {_t} AS tg, coalesce(tax_derived, 0.21e0) AS tax_rate,
  CASE WHEN price > 0 AND shares > 0 THEN greatest(0.05e0, least(0.2e0, price * shares / (price * shares + coalesce(total_debt, 0)) * (risk_free + coalesce(beta, 1) * 0.055e0)
   + coalesce(total_debt, 0) / (price * shares + coalesce(total_debt, 0)) * coalesce(debt_cost, 0.05e0) * (1 - coalesce(tax_derived, 0.21e0)))) END AS wacc
FROM {_rows}
""")
    cte(f"{_name}_flows", f"""
SELECT rid, y, wacc, tg, revenue * pow(1 + growth, y) * (margin * (1 - tax_rate) - 0.01e0) - 0.01e0 * (revenue * pow(1 + growth, y) - revenue * pow(1 + growth, y - 1)) AS fcf
FROM {_name}_rates, years5 WHERE revenue > 0
""")
    cte(_name, f"""
SELECT r.*, ev AS enterprise_value, ev - coalesce(total_debt, 0) + coalesce(cash, 0) AS equity_value,
  (ev - coalesce(total_debt, 0) + coalesce(cash, 0)) / shares AS intrinsic_value,
  CASE WHEN price IS NULL THEN 'price_not_positive' WHEN wacc <= tg THEN 'wacc_not_above_growth' END AS dcf_error
FROM {_name}_rates AS r LEFT JOIN (SELECT rid, sum(fcf / pow(1 + wacc, y)) +
   max(CASE WHEN wacc > tg THEN fcf * (1 + tg) / (wacc - tg) END) FILTER (y = 5) / pow(1 + max(wacc), 5) AS ev FROM {_name}_flows GROUP BY 1) AS f ON f.rid = r.rid
""")
cte("quoted_medians", """
SELECT sector, median(price / intrinsic_value) AS sector_median, count(*) AS sample_count FROM quoted
WHERE dcf_error IS NULL AND intrinsic_value > 0 AND price <> 0 GROUP BY 1
""")
cte("rsi_year", """
SELECT ticker, CASE WHEN sum(l) = 0 THEN 100e0 ELSE 100e0 - 100e0 / (1 + sum(g) / sum(l)) END AS rsi FROM (
  SELECT ticker, greatest(m, 0) * w AS g, greatest(-m, 0) * w AS l FROM (
    SELECT ticker, m, n, pow(13 / 14e0, CASE WHEN i <= 14 THEN n - 14 ELSE n - i END) / 14 AS w FROM (
      SELECT ticker, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY ticker) - 1 AS n, close - lag(close) OVER w AS m
      FROM company_prices WHERE date BETWEEN DATE '2000-06-30' AND DATE '2001-06-30' WINDOW w AS (PARTITION BY ticker ORDER BY date)) WHERE i >= 1) WHERE n >= 14)
GROUP BY ticker
""")
cte("trend", """
SELECT ticker, count(*) = 200 AND arg_max(close, date) >= avg(close) * 0.98e0 AS trend_ok
FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM company_prices WHERE date <= DATE '2001-06-30')
WHERE rn <= 200 GROUP BY ticker
""")
cte("signals", """
SELECT c.ticker, coalesce(c.sector, 'Unknown') AS sector, z.altman_z, f.f_score, t.trend_ok, r.rsi,
  CASE WHEN z.altman_z IS NULL OR z.altman_z < 1.8e0 THEN 'altman_distress' WHEN NOT coalesce(t.trend_ok, false) THEN 'below_trend'
    WHEN coalesce(f.f_score, 0) < 5 THEN 'weak_f_score' WHEN r.rsi IS NULL OR r.rsi >= 45 THEN 'rsi_not_low' END AS gate
FROM companies AS c LEFT JOIN z_scores AS z ON z.ticker = c.ticker AND z.as_of = DATE '2001-06-30'
LEFT JOIN f_scores AS f ON f.ticker = c.ticker AND f.as_of = DATE '2001-06-30'
LEFT JOIN trend AS t ON t.ticker = c.ticker LEFT JOIN rsi_year AS r ON r.ticker = c.ticker
""")
cte("doc_stats", """
SELECT r_name, sum(CAST(c_acctbal AS DECIMAL(18,2)))::DOUBLE / 1e6 AS m, count(*) % 5 AS c
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1
""")

BLEND = "0.6e0 * conviction + 0.4e0 * greatest(0, least(2e0, coalesce(fcf_yield, 0) * 10))"

SQL = {
    "a2_sector_medians": build("SELECT as_of, sector, sector_median FROM medians", r6=["sector_median"]),
    "a3_sample_counts": build("SELECT as_of, sector, sample_count FROM medians"),
    "a4_universe_snapshot": build("""
SELECT DATE '2001-06-30' AS as_of, m.*, (SELECT count(*) FROM quoted) AS universe_size, (SELECT sum(sample_count)::BIGINT FROM quoted_medians) AS tickers_used,
  (SELECT risk_free FROM rf_at WHERE as_of = DATE '2001-06-30') AS risk_free_rate FROM quoted_medians AS m""", r6=["sector_median", "risk_free_rate"]),
    "a17_run_tally": build("SELECT as_of, coalesce(skip_reason, 'valid') AS outcome, count(*) AS companies FROM valuations GROUP BY 1, 2"),
    "f8_sector_filter": build("""
SELECT v.ticker, v.as_of, price_to_intrinsic <= sector_median AS passes FROM valuations AS v
JOIN medians AS m ON m.as_of = v.as_of AND m.sector = v.sector WHERE skip_reason IS NULL"""),
    "f9_compounder_gate": build("""
SELECT ticker, as_of, coalesce(fcf_growth > 0 AND roic > 0, false) AS compounds FROM valuations WHERE skip_reason IS NULL"""),
    "f11_entry_gates": build("SELECT ticker, gate FROM signals"),
    "f12_profit_take": build("""
SELECT symbol AS ticker, coalesce(current_price >= intrinsic_value, false) AS take_profit FROM positions
LEFT JOIN valuations AS v ON v.ticker = symbol AND as_of = DATE '2001-06-30'"""),
    "f15_comparison_bars": build("""
SELECT v.ticker, v.as_of, price_to_intrinsic <= sector_median AS passes,
  least(100, price_to_intrinsic / (greatest(price_to_intrinsic, sector_median) * 1.15e0) * 100) AS stock_bar,
  least(100, sector_median / (greatest(price_to_intrinsic, sector_median) * 1.15e0) * 100) AS median_bar
FROM valuations AS v JOIN medians AS m ON m.as_of = v.as_of AND m.sector = v.sector WHERE price_to_intrinsic IS NOT NULL""", r6=["stock_bar", "median_bar"]),
    "f16_upside": build("""
SELECT ticker, as_of, intrinsic_value - price AS upside, (intrinsic_value - price) / nullif(price, 0) AS upside_pct FROM valuations""", r6=["upside", "upside_pct"]),
    "j3_sector_median_join": build("""
SELECT v.ticker, v.as_of, v.sector, sector_median FROM valuations AS v LEFT JOIN medians AS m ON m.as_of = v.as_of AND m.sector = v.sector""", r6=["sector_median"]),
    "k1_top_picks": build("""
SELECT as_of, pick_rank::INTEGER AS pick_rank, ticker, sector, price, intrinsic_value, price_to_intrinsic, sector_median, fcf_growth, roic, conviction FROM picks""",
        r6=["price", "intrinsic_value", "price_to_intrinsic", "sector_median", "fcf_growth", "roic", "conviction"]),
    "k4_sectors_by_median": build("SELECT * FROM medians ORDER BY as_of, sector_median, sector", r6=["sector_median"]),
    "x15_conviction": build("SELECT ticker, as_of, conviction FROM scores WHERE conviction IS NOT NULL", r6=["conviction"]),
    "x16_scores": build("SELECT * FROM scores", r6=["price", "intrinsic_value", "price_to_intrinsic", "wacc", "sector_median", "fcf_growth", "roic",
        "beta", "fcf_yield", "conviction"]),
    "x17_yield_blend": build(f"SELECT ticker, as_of, fcf_yield, {BLEND} AS conviction FROM scores", r6=["fcf_yield", "conviction"]),
    "p11_daily_scan": build(f"""
SELECT s.ticker, s.as_of, s.sector, price_to_intrinsic, sector_median, g.altman_z, g.trend_ok, g.rsi, g.f_score,
  CASE WHEN s.skip_reason IS NULL AND g.gate IS NULL THEN {BLEND} END AS conviction, coalesce(s.skip_reason, g.gate) AS skip_reason
FROM scores AS s LEFT JOIN signals AS g ON g.ticker = s.ticker WHERE s.as_of = DATE '2001-06-30'""",
        r6=["price_to_intrinsic", "sector_median", "altman_z", "rsi", "conviction"], big=["f_score"]),
    "p13_evaluate_requests": build(f"""
SELECT a.ticker, a.sector, a.price, CASE WHEN error IS NULL THEN wacc END AS wacc,
  CASE WHEN error IS NULL THEN enterprise_value END AS enterprise_value, CASE WHEN error IS NULL THEN equity_value END AS equity_value,
  CASE WHEN error IS NULL THEN intrinsic_value END AS intrinsic_value, CASE WHEN error IS NULL THEN growth END AS growth,
  CASE WHEN error IS NULL THEN margin END AS margin,
  CASE WHEN error IS NULL AND intrinsic_value > 0 THEN price / intrinsic_value END AS price_to_intrinsic,
  CASE WHEN refused IS NULL AND gr IS NULL AND mr IS NULL AND tr = 0.025e0 AND sample_count >= 3 THEN sector_median END AS sector_median,
  CASE WHEN refused IS NOT NULL THEN NULL WHEN gr IS NOT NULL OR mr IS NOT NULL OR tr <> 0.025e0 THEN 'different_assumptions' WHEN sector_median IS NULL THEN 'no_sector'
    WHEN sample_count < 3 THEN 'too_few_samples' END AS unavailable_reason, error AS dcf_error,
  CASE WHEN gr IS NULL THEN 'historical' ELSE 'custom' END AS growth_source, CASE WHEN mr IS NULL THEN 'historical' ELSE 'custom' END AS margin_source,
  {', '.join(f"CASE WHEN error IS NULL THEN f{y} END AS fcf_{y}" for y in range(1, 6))}
FROM (SELECT *, coalesce(refused, dcf_error) AS error FROM asked) AS a LEFT JOIN quoted_medians AS q ON q.sector = a.sector
LEFT JOIN (SELECT rid, {', '.join(f"max(fcf) FILTER (y = {y}) AS f{y}" for y in range(1, 6))} FROM asked_flows GROUP BY 1) AS f ON f.rid = a.rid""",
        r2=["enterprise_value", "equity_value", *(f"fcf_{y}" for y in range(1, 6))], r6=["price", "wacc", "intrinsic_value", "growth", "margin", "price_to_intrinsic", "sector_median"]),
    "l1_median_lookup": build("""
SELECT n_nationkey::BIGINT AS doc_id, s.sector, risk_free, CASE WHEN reason IS NULL THEN m END AS sector_median, reason AS unavailable_reason
FROM (SELECT *, CASE n_nationkey % 12 WHEN 1 THEN 'malformed' WHEN 2 THEN 'not_generated' WHEN 3 THEN 'bad_timestamp' WHEN 4 THEN 'naive_timestamp'
    WHEN 5 THEN 'stale' WHEN 6 THEN 'bad_universe_size' WHEN 7 THEN 'bad_tickers_used' WHEN 8 THEN 'empty_universe' WHEN 9 THEN 'low_coverage'
    WHEN 10 THEN 'different_assumptions' WHEN 11 THEN 'bad_cached_rate' ELSE
    CASE WHEN risk_free > 0.0455e0 THEN 'rate_differs' WHEN m IS NULL THEN 'no_sector' WHEN c < 3 THEN 'too_few_samples' END END AS reason
  FROM nation, (VALUES ('AFRICA'), ('AMERICA'), ('ASIA'), ('EUROPE'), ('MIDDLE EAST'), ('NONE')) AS q(sector), (VALUES (0.0451e0), (0.05e0)) AS v(risk_free)
  LEFT JOIN doc_stats ON r_name = q.sector) AS s""", r6=["sector_median"]),
    "l2_tolerant_read": build("""
SELECT n_nationkey::BIGINT AS doc_id, n_nationkey % 12 = 1 AS malformed,
  CASE n_nationkey % 12 WHEN 1 THEN NULL WHEN 6 THEN NULL WHEN 8 THEN 0e0 ELSE 100e0 END AS universe_size,
  CASE WHEN n_nationkey % 12 <> 1 THEN (SELECT count(*) FROM doc_stats) END AS sectors FROM nation"""),
}
