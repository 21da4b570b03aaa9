"""Named DuckDB table expressions; `build` prepends the ones a query mentions."""

from __future__ import annotations

import re

CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql.strip()


def _mentions(sql: str) -> list[str]:
    words = set(re.findall(r"[A-Za-z_][A-Za-z0-9_]*", sql))
    return [n for n in CTES if n in words]


def build(sql: str, r6=(), r2=(), big=()) -> str:
    """Full statement with its table expressions; r6/r2 columns are rounded, big cast to bigint."""
    need: list[str] = []

    def visit(name):
        if name in need:
            return
        for dep in _mentions(CTES[name]):
            if dep != name:
                visit(dep)
        need.append(name)

    for name in _mentions(sql):
        visit(name)
    body = sql.strip()
    fixes = [f"round({c}, 6) + 0e0 AS {c}" for c in r6]
    fixes += [f"round({c}, 2) + 0e0 AS {c}" for c in r2]
    fixes += [f"CAST({c} AS BIGINT) AS {c}" for c in big]
    if fixes:
        body = f"SELECT * REPLACE ({', '.join(fixes)}) FROM (\n{body}\n) AS result"
    if not need:
        return body
    if re.match(r"(?i)with\s+recursive\s", body):
        inner = re.sub(r"(?i)^with\s+recursive\s+", "", body)
        return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({CTES[n]})" for n in need) + ",\n" + inner
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in need) + "\n" + body


# ---- fixture tables -------------------------------------------------------------------------

cte("base_facts", """
SELECT l_suppkey AS k, year(l_shipdate) AS fy,
  coalesce(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))), 0)::DOUBLE AS rev,
  coalesce(sum(CAST(l_extendedprice AS DECIMAL(18,4))) FILTER (l_returnflag = 'R'), 0)::DOUBLE AS ret,
  coalesce(sum(CAST(l_extendedprice * l_tax AS DECIMAL(18,4))), 0)::DOUBLE AS tax,
  coalesce(sum(CAST(l_quantity AS DECIMAL(18,4))), 0)::DOUBLE AS q,
  coalesce(sum(CAST(l_extendedprice AS DECIMAL(18,4))), 0)::DOUBLE AS ep
FROM lineitem WHERE year(l_shipdate) <= 2000 GROUP BY 1, 2
""")
cte("facts_wide", """
SELECT 'S' || lpad(k::VARCHAR, 5, '0') AS ticker, k, make_date(fy, 12, 31) AS period_end,
  rev, ret, tax, q, ep, 0.35e0 * rev - 0.4e0 * ret AS core,
  CASE WHEN k % 41 = 0 THEN -0.05e0 * rev ELSE 0.35e0 * rev - 0.4e0 * ret END AS ebit,
  0.02e0 * ep AS interest, 0.4e0 * rev + 0.15e0 * ep AS liab
FROM base_facts
""")
cte("statements", """
SELECT ticker, u.statement, u.line_item, period_end, u.value FROM (
 SELECT ticker, period_end, unnest([
  {'statement': 'income', 'line_item': CASE WHEN k % 19 = 0 THEN 'TotalRevenue' ELSE 'Total Revenue' END, 'value': rev},
  {'statement': 'income', 'line_item': CASE WHEN k % 17 = 0 THEN 'Operating Income' ELSE 'EBIT' END, 'value': ebit},
  {'statement': 'income', 'line_item': 'Interest Expense', 'value': interest},
  {'statement': 'income', 'line_item': 'Pretax Income', 'value': ebit - interest},
  {'statement': 'income', 'line_item': 'Tax Provision', 'value': tax},
  {'statement': 'income', 'line_item': 'Net Income', 'value': ebit - interest - tax},
  {'statement': 'income', 'line_item': 'Gross Profit', 'value': 0.5e0 * rev - 0.2e0 * ret},
  {'statement': 'balance', 'line_item': 'Total Debt', 'value': 0.4e0 * rev},
  {'statement': 'balance', 'line_item': 'Long Term Debt', 'value': 0.3e0 * rev},
  {'statement': 'balance', 'line_item': 'Cash And Cash Equivalents', 'value': CASE WHEN k % 11 <> 0 THEN 0.1e0 * rev END},
  {'statement': 'balance', 'line_item': 'Total Assets', 'value': 1.2e0 * ep},
  {'statement': 'balance', 'line_item': 'Current Assets', 'value': 0.4e0 * ep},
  {'statement': 'balance', 'line_item': 'Current Liabilities', 'value': 0.15e0 * ep + 0.3e0 * ret},
  {'statement': 'balance', 'line_item': 'Retained Earnings', 'value': CASE WHEN k % 9 = 0 THEN -rev ELSE 0.3e0 * rev END},
  {'statement': 'balance', 'line_item': 'Total Liabilities Net Minority Interest', 'value': CASE WHEN k % 9 = 0 THEN 1.32e0 * ep ELSE liab END},
  {'statement': 'balance', 'line_item': 'Stockholders Equity', 'value': 1.2e0 * ep - liab},
  {'statement': 'balance', 'line_item': 'Share Issued', 'value': 1e6 + q},
  {'statement': 'cash_flow', 'line_item': 'Operating Cash Flow', 'value': 0.79e0 * core + 0.03e0 * rev},
  {'statement': 'cash_flow', 'line_item': 'Capital Expenditure', 'value': -0.05e0 * ep}
 ]) AS u FROM facts_wide)
""")
cte("companies", """
SELECT 'S' || lpad(s_suppkey::VARCHAR, 5, '0') AS ticker,
  CASE WHEN s_suppkey % 23 <> 0 THEN r_name END AS sector, 'N' || s_nationkey AS industry,
  CASE WHEN s_suppkey % 31 = 0 THEN 5e0 WHEN s_suppkey % 37 = 0 THEN -0.5e0
       WHEN s_suppkey % 29 = 0 THEN NULL ELSE 0.4e0 + 0.1e0 * (s_suppkey % 13) END AS beta,
  CASE WHEN s_suppkey % 12 = 0 THEN 0e0 WHEN s_suppkey % 15 <> 0 THEN 90e0 + s_suppkey % 40 END AS last_price,
  CASE WHEN s_suppkey % 60 <> 0 THEN 80e0 + s_suppkey % 50 END AS alt_price,
  100000e0 + 1000e0 * (s_suppkey % 7) AS shares_outstanding, s_suppkey::INTEGER AS universe_pos
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""")
cte("daily", """
SELECT l_suppkey AS k, l_shipdate::DATE AS date,
  sum(CAST((1 - l_discount) * (1 + l_tax) AS DECIMAL(18,4))) AS s,
  sum(CAST(l_discount AS DECIMAL(18,4))) AS sd, sum(CAST(l_tax AS DECIMAL(18,4))) AS st, count(*) AS n
FROM lineitem GROUP BY 1, 2
""")
cte("company_prices", """
SELECT 'S' || lpad(k::VARCHAR, 5, '0') AS ticker, date, 100e0 * s::DOUBLE / n AS close FROM daily
""")
cte("region_prices", """
SELECT 'R_' || r_name AS ticker, date, 100e0 * sum(s)::DOUBLE / sum(n)::BIGINT AS close
FROM daily JOIN supplier ON k = s_suppkey JOIN nation ON s_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, date
""")
cte("macro_prices", """
SELECT 'IDX' AS ticker, date, 100e0 * sum(s)::DOUBLE / sum(n)::BIGINT AS close FROM daily GROUP BY date
UNION ALL SELECT '^RF', date, 4e0 + 10e0 * (sum(sd)::DOUBLE / sum(n)::BIGINT) FROM daily GROUP BY date
UNION ALL SELECT '^VIX', date, 12e0 + 100e0 * (sum(st)::DOUBLE / sum(n)::BIGINT) FROM daily GROUP BY date
""")
cte("prices", "SELECT * FROM company_prices UNION ALL SELECT * FROM macro_prices")
cte("splits", """
SELECT 'S' || lpad(s_suppkey::VARCHAR, 5, '0') AS ticker,
  CASE WHEN s_suppkey % 10 = 3 THEN DATE '1999-06-15' ELSE DATE '2001-08-01' END AS date,
  CASE WHEN s_suppkey % 10 = 3 THEN 2e0 ELSE 3e0 END AS ratio
FROM supplier WHERE s_suppkey % 10 IN (3, 6)
""")
cte("shares", """
SELECT 'S' || lpad(s_suppkey::VARCHAR, 5, '0') AS ticker, make_date(y::INTEGER, 1, 15) AS date,
  (100000e0 + 1000e0 * (s_suppkey % 7)) / CASE WHEN s_suppkey % 10 = 3 AND y <= 1999 THEN 2e0
    WHEN s_suppkey % 10 = 6 AND y <= 2001 THEN 3e0 ELSE 1e0 END AS shares
FROM supplier, generate_series(1996, 2001) AS g(y) WHERE s_suppkey % 5 <> 0
""")
cte("positions", """
SELECT CASE WHEN s_suppkey % 40 = 0 THEN 'SPY' ELSE '' END || 'S' || lpad(s_suppkey::VARCHAR, 5, '0') AS symbol,
  CASE WHEN s_suppkey % 40 = 0 THEN 'us_option' ELSE 'us_equity' END AS asset_class,
  (2000e0 + 500e0 * (s_suppkey % 30)) / (50e0 + s_suppkey % 60) AS qty,
  2000e0 + 500e0 * (s_suppkey % 30) AS market_value, 50e0 + s_suppkey % 60 AS current_price,
  45e0 + s_suppkey % 70 AS avg_entry_price
FROM supplier WHERE s_suppkey % 4 = 0
""")
cte("order_events", """
SELECT user_id::VARCHAR AS order_id, 'S' || lpad((user_id % 100)::VARCHAR, 5, '0') AS symbol,
  CASE WHEN user_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side,
  CASE event_type WHEN 'view' THEN 'new' WHEN 'click' THEN 'partially_filled'
    WHEN 'purchase' THEN 'filled' WHEN 'error' THEN 'rejected' ELSE 'accepted' END AS status,
  CASE WHEN event_type IN ('purchase', 'click') THEN value ELSE 0e0 END AS filled_qty,
  CASE WHEN event_type IN ('purchase', 'click') AND value > 0 THEN 50e0 + user_id % 60 END AS filled_avg_price,
  ts, event_id
FROM events
""")
cte("access_events", """
SELECT user_id::VARCHAR AS key, ts, event_id, event_type = 'purchase' AS success
FROM events WHERE event_type IN ('error', 'purchase')
""")
cte("option_chain", """
SELECT 'SPY' || lpad(p_partkey::VARCHAR, 7, '0') AS symbol, 'SPY' AS underlying,
  DATE '2001-07-01' + (p_partkey % 61)::INTEGER AS expiration_date, 80e0 + p_partkey % 53 AS strike_price,
  p_partkey % 3 <> 0 AS tradable, p_partkey::INTEGER AS chain_pos
FROM part
""")
cte("trade_logs", """
SELECT ts, event_id, CASE WHEN snap THEN 'PORTFOLIO' ELSE 'S' || lpad((user_id % 100)::VARCHAR, 5, '0') END AS ticker,
  CASE WHEN snap THEN 'RISK_SNAPSHOT' WHEN user_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS action,
  CASE WHEN snap THEN 0e0 ELSE value END AS quantity,
  CASE WHEN snap THEN 0e0 ELSE 50e0 + user_id % 60 END AS execution_price,
  CASE WHEN NOT snap THEN 0.05e0 + (user_id % 15) / 100e0 END AS wacc,
  CASE WHEN NOT snap THEN 0.4e0 + 0.1e0 * (user_id % 13) END AS beta,
  CASE WHEN NOT snap THEN value / 100e0 END AS conviction_score,
  CASE WHEN NOT snap THEN 1e0 + (user_id % 30) / 10e0 END AS altman_z_score,
  CASE WHEN snap AND user_id % 5 <> 0 THEN -value / 1000e0 END AS var_95,
  CASE WHEN snap AND user_id % 5 <> 0 THEN -value / 700e0 END AS cvar_95
FROM (SELECT *, event_type = 'signup' AS snap FROM events WHERE event_type IN ('purchase', 'signup'))
""")
cte("backtest_curve", """
SELECT date_trunc('month', o_orderdate)::DATE AS date,
  sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderkey % 2 = 0)::DOUBLE / count(*) FILTER (o_orderkey % 2 = 0) AS strategy_value,
  sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE / count(*) AS benchmark_value
FROM orders GROUP BY 1
""")
cte("as_of_dates", "SELECT * FROM (VALUES (DATE '2000-06-30'), (DATE '2001-06-30')) AS t(as_of)")
cte("years5", "SELECT y FROM generate_series(1, 5) AS g(y)")

# ---- statements by period -------------------------------------------------------------------

cte("inc", """
SELECT ticker, period_end, max(value) FILTER (line_item = 'Total Revenue') AS revenue_strict,
  coalesce(max(value) FILTER (line_item = 'Total Revenue'), max(value) FILTER (line_item = 'TotalRevenue')) AS revenue,
  coalesce(max(value) FILTER (line_item = 'EBIT'), max(value) FILTER (line_item = 'Operating Income')) AS ebit,
  max(value) FILTER (line_item = 'Interest Expense') AS interest,
  max(value) FILTER (line_item = 'Pretax Income') AS pretax,
  max(value) FILTER (line_item = 'Tax Provision') AS tax_provision,
  max(value) FILTER (line_item = 'Net Income') AS net_income,
  max(value) FILTER (line_item = 'Gross Profit') AS gross_profit
FROM statements WHERE statement = 'income' GROUP BY 1, 2
""")
cte("bal", """
SELECT ticker, period_end, max(value) FILTER (line_item = 'Total Debt') AS total_debt,
  max(value) FILTER (line_item = 'Long Term Debt') AS long_term_debt,
  max(value) FILTER (line_item = 'Cash And Cash Equivalents') AS cash,
  max(value) FILTER (line_item = 'Total Assets') AS total_assets,
  max(value) FILTER (line_item = 'Current Assets') AS current_assets,
  max(value) FILTER (line_item = 'Current Liabilities') AS current_liabilities,
  max(value) FILTER (line_item = 'Retained Earnings') AS retained_earnings,
  max(value) FILTER (line_item = 'Total Liabilities Net Minority Interest') AS total_liabilities,
  max(value) FILTER (line_item = 'Stockholders Equity') AS equity,
  max(value) FILTER (line_item = 'Share Issued') AS shares_issued
FROM statements WHERE statement = 'balance' GROUP BY 1, 2
""")
cte("cfs", """
SELECT ticker, period_end, max(value) FILTER (line_item = 'Operating Cash Flow') AS ocf,
  max(value) FILTER (line_item = 'Capital Expenditure') AS capex,
  max(value) FILTER (line_item = 'Operating Cash Flow') + max(value) FILTER (line_item = 'Capital Expenditure') AS fcf
FROM statements WHERE statement = 'cash_flow' GROUP BY 1, 2
""")
for _t in ("inc", "bal", "cfs"):
    cte(f"{_t}_at", f"""
SELECT x.*, d.as_of, row_number() OVER (PARTITION BY ticker, as_of ORDER BY period_end DESC) AS rn
FROM {_t} AS x JOIN as_of_dates AS d ON x.period_end <= d.as_of - 90
""")
    cte(f"{_t}_now", f"""
SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY period_end DESC) AS rn FROM {_t}
""")
cte("growth_at", """
SELECT ticker, as_of, CASE WHEN first(revenue ORDER BY period_end) > 0 AND last(revenue ORDER BY period_end) > 0
    AND max(period_end) > min(period_end)
  THEN pow(last(revenue ORDER BY period_end) / first(revenue ORDER BY period_end),
           1e0 / ((max(period_end) - min(period_end)) / 365.25e0)) - 1 END AS revenue_cagr
FROM inc_at WHERE revenue IS NOT NULL GROUP BY 1, 2
""")
cte("margin_at", """
SELECT ticker, as_of, avg(ebit / revenue) FILTER (revenue > 0) AS margin_hist FROM inc_at GROUP BY 1, 2
""")
cte("price_at", """
SELECT ticker, as_of, arg_max(close, date) AS price, max(date) AS price_date
FROM company_prices JOIN as_of_dates ON date BETWEEN as_of - 10 AND as_of
WHERE close IS NOT NULL GROUP BY 1, 2
""")
cte("split_at", """
SELECT ticker, as_of, product(ratio) AS split_factor FROM splits JOIN as_of_dates ON date > as_of GROUP BY 1, 2
""")
cte("shares_at", """
SELECT c.ticker, d.as_of, coalesce(h.shares * coalesce(f.split_factor, 1e0), c.shares_outstanding) AS shares,
  h.shares IS NULL AS shares_approximated
FROM companies AS c CROSS JOIN as_of_dates AS d
LEFT JOIN (SELECT s.ticker, a.as_of, arg_max(s.shares, s.date) AS shares FROM shares AS s
           JOIN as_of_dates AS a ON s.date BETWEEN a.as_of - 365 AND a.as_of GROUP BY 1, 2) AS h
  ON h.ticker = c.ticker AND h.as_of = d.as_of
LEFT JOIN split_at AS f ON f.ticker = c.ticker AND f.as_of = d.as_of
""")
cte("rf_at", """
SELECT d.as_of, coalesce((SELECT arg_max(m.close, m.date) FROM macro_prices AS m
  WHERE m.ticker = '^RF' AND m.date BETWEEN d.as_of - 10 AND d.as_of) / 100e0, 0.042e0) AS risk_free
FROM as_of_dates AS d
""")
cte("inputs_at", """
SELECT i.ticker, i.as_of, i.period_end AS income_period, b.period_end AS balance_period, c.period_end AS cash_flow_period,
  i.revenue, i.ebit, i.pretax, i.tax_provision, i.interest, b.total_debt, b.cash, b.equity, c.ocf, c.capex,
  g.revenue_cagr, CASE WHEN g.revenue_cagr > 0.25e0 THEN 0.25e0 ELSE g.revenue_cagr END AS growth_hist, m.margin_hist,
  CASE WHEN i.pretax <> 0 AND i.tax_provision / i.pretax >= 0 AND i.tax_provision / i.pretax < 1
    THEN i.tax_provision / i.pretax END AS tax_derived,
  CASE WHEN i.interest <> 0 AND b.total_debt <> 0 THEN abs(i.interest) / b.total_debt END AS debt_cost,
  CASE WHEN p.fcf > 0 THEN c.fcf / p.fcf - 1 END AS fcf_growth
FROM inc_at AS i
LEFT JOIN bal_at AS b ON b.ticker = i.ticker AND b.as_of = i.as_of AND b.rn = 1
LEFT JOIN cfs_at AS c ON c.ticker = i.ticker AND c.as_of = i.as_of AND c.rn = 1
LEFT JOIN cfs_at AS p ON p.ticker = i.ticker AND p.as_of = i.as_of AND p.rn = 2
LEFT JOIN growth_at AS g ON g.ticker = i.ticker AND g.as_of = i.as_of
LEFT JOIN margin_at AS m ON m.ticker = i.ticker AND m.as_of = i.as_of
WHERE i.rn = 1
""")
cte("market_rows", """
SELECT c.ticker, d.as_of, coalesce(nullif(c.sector, ''), 'Unknown') AS sector, c.universe_pos, c.beta,
  x.* EXCLUDE (ticker, as_of), p.price, s.shares, s.shares_approximated, r.risk_free
FROM companies AS c CROSS JOIN as_of_dates AS d
LEFT JOIN inputs_at AS x ON x.ticker = c.ticker AND x.as_of = d.as_of
LEFT JOIN price_at AS p ON p.ticker = c.ticker AND p.as_of = d.as_of
LEFT JOIN shares_at AS s ON s.ticker = c.ticker AND s.as_of = d.as_of
LEFT JOIN rf_at AS r ON r.as_of = d.as_of
""")
cte("rates", """
SELECT *, CASE WHEN price > 0 AND shares > 0 THEN
  price * shares / (price * shares + coalesce(total_debt, 0e0)) * (risk_free + coalesce(beta, 1e0) * 0.055e0)
  + coalesce(total_debt, 0e0) / (price * shares + coalesce(total_debt, 0e0)) * (coalesce(debt_cost, 0.05e0) * (1 - tax_rate)) END AS raw_wacc
FROM (SELECT *, coalesce(growth_hist, 0.08e0) AS growth, coalesce(margin_hist, 0.15e0) AS margin,
        coalesce(tax_derived, 0.21e0) AS tax_rate FROM market_rows)
""")
cte("wacc_rows", """
SELECT *, CASE WHEN raw_wacc < 0.05e0 THEN 0.05e0 WHEN raw_wacc > 0.2e0 THEN 0.2e0 ELSE raw_wacc END AS wacc FROM rates
""")
cte("flows", """
SELECT ticker, as_of, y, revenue * pow(1 + growth, y) AS projected_revenue,
  revenue * pow(1 + growth, y) * margin AS projected_ebit,
  revenue * pow(1 + growth, y) * margin * (1 - tax_rate) AS nopat,
  revenue * pow(1 + growth, y) * 0.03e0 AS da, revenue * pow(1 + growth, y) * 0.04e0 AS projected_capex,
  (revenue * pow(1 + growth, y) - revenue * pow(1 + growth, y - 1)) * 0.01e0 AS change_in_nwc,
  revenue * pow(1 + growth, y) * margin * (1 - tax_rate) + revenue * pow(1 + growth, y) * 0.03e0
   - revenue * pow(1 + growth, y) * 0.04e0
   - (revenue * pow(1 + growth, y) - revenue * pow(1 + growth, y - 1)) * 0.01e0 AS fcf, wacc
FROM wacc_rows, years5 WHERE revenue > 0
""")
cte("dcf", """
SELECT w.*, f.final_fcf, f.terminal_value, f.pv_explicit_fcf, f.pv_terminal_value,
  f.pv_explicit_fcf + f.pv_terminal_value AS enterprise_value,
  f.pv_explicit_fcf + f.pv_terminal_value - coalesce(total_debt, 0e0) + coalesce(cash, 0e0) AS equity_value,
  (f.pv_explicit_fcf + f.pv_terminal_value - coalesce(total_debt, 0e0) + coalesce(cash, 0e0)) / shares AS intrinsic_value,
  CASE WHEN price > 0 AND shares > 0 THEN price * shares + coalesce(total_debt, 0e0) - coalesce(cash, 0e0) END AS market_enterprise_value
FROM wacc_rows AS w LEFT JOIN (
  SELECT ticker, as_of, max(fcf) FILTER (y = 5) AS final_fcf, sum(fcf / pow(1 + wacc, y)) AS pv_explicit_fcf,
    max(CASE WHEN wacc > 0.025e0 THEN fcf * 1.025e0 / (wacc - 0.025e0) END) FILTER (y = 5) AS terminal_value,
    max(CASE WHEN wacc > 0.025e0 THEN fcf * 1.025e0 / (wacc - 0.025e0) END) FILTER (y = 5) / pow(1 + max(wacc), 5) AS pv_terminal_value
  FROM flows GROUP BY 1, 2) AS f ON f.ticker = w.ticker AND f.as_of = w.as_of
""")
cte("valued", """
SELECT *, CASE WHEN intrinsic_value > 0 THEN price / intrinsic_value END AS price_to_intrinsic,
  CASE WHEN market_enterprise_value > 0 THEN (ocf + capex) / market_enterprise_value END AS fcf_yield,
  CASE WHEN coalesce(total_debt, 0e0) + equity - coalesce(cash, 0e0) > 0
    THEN ebit * (1 - tax_rate) / (coalesce(total_debt, 0e0) + equity - coalesce(cash, 0e0)) END AS roic,
  CASE WHEN income_period IS NULL OR balance_period IS NULL THEN 'no_statements'
    WHEN price IS NULL THEN 'no_price' WHEN shares IS NULL THEN 'no_shares'
    WHEN price < 0 THEN 'invalid_price' WHEN shares < 0 THEN 'invalid_shares'
    WHEN total_debt < 0 THEN 'invalid_total_debt' WHEN cash < 0 THEN 'invalid_cash'
    WHEN revenue IS NULL THEN 'no_revenue' WHEN price <= 0 THEN 'price_not_positive'
    WHEN shares <= 0 THEN 'shares_not_positive' WHEN wacc IS NULL THEN 'no_wacc'
    WHEN revenue <= 0 THEN 'revenue_not_positive' WHEN wacc <= 0.025e0 THEN 'wacc_not_above_growth'
    WHEN enterprise_value IS NULL THEN 'value_not_finite'
    WHEN intrinsic_value IS NULL OR intrinsic_value <= 0 THEN 'intrinsic_value_not_positive' END AS skip_reason
FROM dcf
""")
cte("valuations", """
SELECT ticker, as_of, sector, universe_pos, skip_reason,
  CASE WHEN skip_reason IS NULL THEN price END AS price,
  CASE WHEN skip_reason IS NULL THEN intrinsic_value END AS intrinsic_value,
  CASE WHEN skip_reason IS NULL THEN price_to_intrinsic END AS price_to_intrinsic,
  CASE WHEN skip_reason IS NULL THEN wacc END AS wacc, CASE WHEN skip_reason IS NULL THEN beta END AS beta,
  CASE WHEN skip_reason IS NULL THEN fcf_yield END AS fcf_yield,
  CASE WHEN skip_reason IS NULL THEN tax_rate END AS tax_rate,
  CASE WHEN skip_reason IS NULL THEN fcf_growth END AS fcf_growth,
  CASE WHEN skip_reason IS NULL THEN roic END AS roic,
  CASE WHEN skip_reason IS NOT NULL THEN '' WHEN shares_approximated THEN 'beta,sector,shares_outstanding'
    ELSE 'beta,sector' END AS approximations
FROM valued
""")
cte("medians", """
SELECT as_of, sector, median(price_to_intrinsic) AS sector_median, count(*) AS sample_count
FROM valuations WHERE skip_reason IS NULL GROUP BY 1, 2
""")
cte("scored", """
SELECT v.* REPLACE (
    CASE WHEN v.skip_reason IS NOT NULL THEN v.skip_reason WHEN sector_median IS NULL THEN 'no_sector_median'
      WHEN price_to_intrinsic > sector_median THEN 'above_sector_median' WHEN fcf_growth IS NULL THEN 'no_fcf_growth'
      WHEN roic IS NULL THEN 'no_roic' WHEN fcf_growth <= 0 OR roic <= 0 THEN 'not_compounding' END AS skip_reason),
  v.skip_reason AS first_skip, sector_median,
  fcf_growth * roic / CASE WHEN price_to_intrinsic < 0.05e0 THEN 0.05e0 ELSE price_to_intrinsic END AS raw_conviction
FROM valuations AS v LEFT JOIN medians AS m ON m.as_of = v.as_of AND m.sector = v.sector
""")
cte("scores", """
SELECT ticker, as_of, sector, universe_pos, price, intrinsic_value, price_to_intrinsic, wacc, sector_median, approximations,
  CASE WHEN skip_reason IS NULL OR skip_reason = 'not_compounding' THEN fcf_growth END AS fcf_growth,
  CASE WHEN skip_reason IS NULL OR skip_reason = 'not_compounding' THEN roic END AS roic,
  CASE WHEN skip_reason IS NULL THEN beta END AS beta, CASE WHEN skip_reason IS NULL THEN fcf_yield END AS fcf_yield,
  CASE WHEN skip_reason IS NULL THEN 2e0 * raw_conviction / (raw_conviction + 0.1e0) END AS conviction, skip_reason
FROM (SELECT * REPLACE (CASE WHEN first_skip IS NULL THEN sector_median END AS sector_median) FROM scored)
""")
cte("picks", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY conviction DESC, universe_pos) AS pick_rank
  FROM scores WHERE skip_reason IS NULL) WHERE pick_rank <= 10
""")

# ---- regulatory facts -----------------------------------------------------------------------

cte("xbrl_rows", """
SELECT 'S' || lpad(k::VARCHAR, 5, '0') AS ticker, (1000 + k)::VARCHAR AS cik, tag, copy, form,
  CASE WHEN NOT instant THEN make_date(fy, m, 1) END AS start, make_date(fy, 12, 31) AS "end", val * scale AS val,
  lpad((1000 + k)::VARCHAR, 10, '0') || '-' || lpad(((fy + 1) % 100)::VARCHAR, 2, '0') || '-' || lpad(copy::VARCHAR, 6, '0') AS accn,
  make_date(fy, 12, 31) + delay AS filed, k, fy
FROM (
  SELECT k, fy, 'RevenueFromContractWithCustomerExcludingAssessedTax' AS tag, rev AS val, false AS instant FROM facts_fy WHERE NOT (k % 3 = 0 AND fy <= 1997)
  UNION ALL SELECT k, fy, 'Revenues', rev + 1, false FROM facts_fy WHERE k % 3 = 0 AND fy <= 1998
  UNION ALL SELECT k, fy, 'OperatingIncomeLoss', ebit, false FROM facts_fy
  UNION ALL SELECT k, fy, 'IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest', ebit - interest, false FROM facts_fy
  UNION ALL SELECT k, fy, 'IncomeTaxExpenseBenefit', tax, false FROM facts_fy WHERE NOT (k % 13 = 0 AND fy = 2000)
  UNION ALL SELECT k, fy, 'InterestExpense', interest, false FROM facts_fy WHERE k % 4 <> 0
  UNION ALL SELECT k, fy, 'InterestExpenseNonoperating', interest, false FROM facts_fy WHERE k % 4 = 0
  UNION ALL SELECT k, fy, 'CashAndCashEquivalentsAtCarryingValue', 0.1e0 * rev, true FROM facts_fy WHERE k % 11 <> 0
  UNION ALL SELECT k, fy, 'LongTermDebtNoncurrent', 0.3e0 * rev, true FROM facts_fy WHERE k % 5 <> 0
  UNION ALL SELECT k, fy, 'LongTermDebtCurrent', 0.1e0 * rev, true FROM facts_fy WHERE k % 5 <> 0
  UNION ALL SELECT k, fy, 'DebtLongtermAndShorttermCombinedAmount', 0.4e0 * rev, true FROM facts_fy WHERE k % 5 = 0
) CROSS JOIN (VALUES (0, '10-Q', 0.25e0, 10, 20), (1, '10-K', 0.25e0, 10, 45), (2, '10-K', 1e0, 1, 45), (3, '10-K', 1.01e0, 1, 410)) AS c(copy, form, scale, m, delay)
WHERE NOT instant OR copy <> 1
""")
cte("facts_fy", "SELECT *, year(period_end) AS fy FROM facts_wide")
cte("annual", """
SELECT * FROM xbrl_rows WHERE form = '10-K' AND (start IS NULL OR "end" - start BETWEEN 330 AND 400)
""")
cte("firsts", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, tag, "end" ORDER BY filed, copy) AS rn FROM annual) WHERE rn = 1
""")
cte("fields", """
SELECT * FROM (SELECT f.*, field, row_number() OVER (PARTITION BY ticker, field, "end" ORDER BY prio) AS pick
  FROM firsts AS f JOIN (VALUES ('RevenueFromContractWithCustomerExcludingAssessedTax', 'revenue', 1), ('Revenues', 'revenue', 2),
    ('OperatingIncomeLoss', 'ebit', 1), ('IncomeTaxExpenseBenefit', 'tax', 1), ('InterestExpense', 'interest', 1),
    ('InterestExpenseNonoperating', 'interest', 2),
    ('IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest', 'pretax', 1)) AS p(tag, field, prio)
  ON p.tag = f.tag) WHERE pick = 1
""")
cte("latest_fy", """
SELECT ticker, max("end") AS latest_end FROM (SELECT ticker, "end" FROM fields WHERE field = 'revenue'
  INTERSECT SELECT ticker, "end" FROM fields WHERE field = 'pretax' INTERSECT SELECT ticker, "end" FROM fields WHERE field = 'tax') GROUP BY 1
""")
cte("inst", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, tag, "end" ORDER BY copy) AS rn FROM xbrl_rows
  WHERE form = '10-K' AND start IS NULL) WHERE rn = 1
""")
cte("hist5", """
SELECT * FROM (SELECT r.ticker, r."end", r.val AS revenue, e.val AS ebit, r.tag AS revenue_tag, r.accn AS revenue_accn, e.accn AS ebit_accn,
  row_number() OVER (PARTITION BY r.ticker ORDER BY r."end" DESC) AS years_back
  FROM fields AS r JOIN fields AS e ON e.ticker = r.ticker AND e."end" = r."end" AND e.field = 'ebit' WHERE r.field = 'revenue') WHERE years_back <= 5
""")
cte("debt_roll", """
SELECT l.ticker, l.latest_end, coalesce(c.val, s.total) AS total_debt, CASE WHEN c.val IS NOT NULL THEN 'reported' ELSE 'summed' END AS method,
  CASE WHEN c.val IS NOT NULL THEN '' ELSE s.tags END AS component_tags, CASE WHEN c.val IS NOT NULL THEN c.accn ELSE s.accns END AS accessions,
  CASE WHEN c.val IS NOT NULL THEN '' ELSE s.dates END AS filed_dates, CASE WHEN c.val IS NOT NULL THEN '' ELSE s.urls END AS source_urls
FROM latest_fy AS l
LEFT JOIN inst AS c ON c.ticker = l.ticker AND c."end" = l.latest_end AND c.tag = 'DebtLongtermAndShorttermCombinedAmount'
LEFT JOIN (SELECT i.ticker, i."end", sum(val ORDER BY tag DESC) AS total, string_agg(tag, '; ' ORDER BY tag DESC) AS tags,
    any_value(accn) AS accns, any_value(filed::VARCHAR) AS dates,
    any_value('https://www.sec.gov/Archives/edgar/data/' || cik || '/' || replace(accn, '-', '') || '/' || accn || '-index.htm') AS urls
  FROM inst AS i WHERE tag IN ('LongTermDebtNoncurrent', 'LongTermDebtCurrent') GROUP BY 1, 2) AS s
  ON s.ticker = l.ticker AND s."end" = l.latest_end
WHERE c.val IS NOT NULL OR s.total IS NOT NULL
""")

# ---- snapshots and news ---------------------------------------------------------------------

cte("snap", """
SELECT c.ticker AS file_ticker, universe_pos AS k, CASE WHEN universe_pos % 18 = 0 THEN 'X' ELSE '' END || c.ticker AS ticker,
  universe_pos % 21 = 0 AS malformed, universe_pos % 26 <> 0 AS has_latest, universe_pos % 27 <> 0 AS has_history,
  alt_price, shares_outstanding, beta, sector
FROM companies AS c WHERE universe_pos IN (SELECT k FROM base_facts)
""")
cte("snap_hist", """
SELECT s.*, f.period_end, f.rev, f.ebit, f.interest, f.tax, max(f.period_end) OVER (PARTITION BY s.k) AS newest
FROM snap AS s JOIN facts_wide AS f ON f.k = s.k
WHERE NOT malformed AND has_latest AND has_history
""")
cte("snap_statements", """
SELECT ticker, statement, line_item, period_end, value FROM (
 SELECT ticker, period_end, unnest([
  {'statement': 'income', 'line_item': 'Total Revenue', 'value': rev, 'newest_only': false},
  {'statement': 'income', 'line_item': 'EBIT', 'value': ebit, 'newest_only': false},
  {'statement': 'income', 'line_item': 'Pretax Income', 'value': CASE WHEN period_end = DATE '2000-12-31' THEN ebit - interest END, 'newest_only': false},
  {'statement': 'income', 'line_item': 'Tax Provision', 'value': CASE WHEN period_end = DATE '2000-12-31' THEN tax END, 'newest_only': false},
  {'statement': 'income', 'line_item': 'Interest Expense', 'value': CASE WHEN period_end = DATE '2000-12-31' THEN interest END, 'newest_only': false},
  {'statement': 'balance', 'line_item': 'Total Debt', 'value': 0.4e0 * rev, 'newest_only': true},
  {'statement': 'balance', 'line_item': 'Cash And Cash Equivalents', 'value': CASE WHEN k % 11 <> 0 THEN 0.1e0 * rev END, 'newest_only': true}
 ], recursive := true) FROM snap_hist)
WHERE NOT newest_only OR period_end = DATE '2000-12-31'
""")
cte("news_items", """
SELECT 'S' || lpad((page_id // 8)::VARCHAR, 5, '0') AS ticker, page_id, (page_id % 8)::INTEGER AS pos, page_id % 2 = 0 AS nested,
  CASE WHEN page_id % 7 <> 0 THEN 'Story ' || page_id END AS title, 'P' || page_id % 5 AS publisher, url,
  CASE WHEN page_id % 3 = 0 THEN url ELSE url || '#click' END AS link,
  '2024-01-' || lpad((page_id % 28 + 1)::VARCHAR, 2, '0') AS published_at
FROM pages WHERE page_id % 8 < 5
""")

# ---- quality scores -------------------------------------------------------------------------

cte("score_dates", "SELECT * FROM (VALUES (DATE '1995-12-31'), (DATE '2001-06-30'), (DATE '2001-08-31')) AS t(as_of)")
for _t in ("inc", "bal", "cfs"):
    cte(f"two_{_t}", f"""
SELECT x.*, d.as_of, row_number() OVER (PARTITION BY ticker, as_of ORDER BY period_end DESC) AS rn
FROM {_t} AS x JOIN score_dates AS d ON x.period_end <= d.as_of
""")
cte("two_years", """
SELECT c.ticker, c.as_of, c.net_income, c.revenue, c.revenue_strict, c.ebit, c.gross_profit, f.ocf,
  b.total_assets, b.current_assets, b.current_liabilities, b.long_term_debt, b.shares_issued, b.retained_earnings, b.total_liabilities,
  coalesce(p.net_income, c.net_income) AS net_income_0, coalesce(p.revenue, c.revenue) AS revenue_0,
  coalesce(p.gross_profit, c.gross_profit) AS gross_profit_0, coalesce(q.total_assets, b.total_assets) AS total_assets_0,
  coalesce(q.current_assets, b.current_assets) AS current_assets_0, coalesce(q.current_liabilities, b.current_liabilities) AS current_liabilities_0,
  coalesce(q.long_term_debt, b.long_term_debt) AS long_term_debt_0, coalesce(q.shares_issued, b.shares_issued) AS shares_issued_0
FROM two_inc AS c LEFT JOIN two_inc AS p ON p.ticker = c.ticker AND p.as_of = c.as_of AND p.rn = 2
LEFT JOIN two_bal AS b ON b.ticker = c.ticker AND b.as_of = c.as_of AND b.rn = 1
LEFT JOIN two_bal AS q ON q.ticker = c.ticker AND q.as_of = c.as_of AND q.rn = 2
LEFT JOIN two_cfs AS f ON f.ticker = c.ticker AND f.as_of = c.as_of AND f.rn = 1
WHERE c.rn = 1
""")
cte("f_scores", """
SELECT ticker, as_of, coalesce((net_income / total_assets > 0)::INTEGER, 0) + coalesce((ocf > 0)::INTEGER, 0)
  + coalesce((ocf > net_income)::INTEGER, 0) + coalesce((net_income / total_assets > net_income_0 / total_assets_0)::INTEGER, 0)
  + coalesce((coalesce(long_term_debt, 0) / total_assets < coalesce(long_term_debt_0, 0) / total_assets_0)::INTEGER, 0)
  + coalesce((current_assets / current_liabilities > current_assets_0 / current_liabilities_0)::INTEGER, 0)
  + coalesce((shares_issued <= shares_issued_0)::INTEGER, 0)
  + coalesce((gross_profit / revenue > gross_profit_0 / revenue_0)::INTEGER, 0)
  + coalesce((revenue / total_assets > revenue_0 / total_assets_0)::INTEGER, 0) AS f_score
FROM two_years
""")
cte("z_scores", """
SELECT t.ticker, t.as_of, 1.2e0 * ((current_assets - current_liabilities) / total_assets) + 1.4e0 * (retained_earnings / total_assets)
  + 3.3e0 * (ebit / total_assets)
  + 0.6e0 * (nullif(shares_outstanding, 0) * coalesce(nullif(last_price, 0), nullif(alt_price, 0)) / total_liabilities)
  + 1e0 * (revenue_strict / total_assets) AS altman_z
FROM two_years AS t JOIN companies AS c ON c.ticker = t.ticker
""")
