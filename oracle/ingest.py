from oracle.ctes import build

SQL = {
    "s1_statements_long": build("""
SELECT l.ticker, l.statement, l.line_item, d.p AS period_end, s.value
FROM (SELECT DISTINCT ticker, statement, line_item FROM statements) AS l
CROSS JOIN (SELECT make_date(y::INTEGER, 12, 31) AS p FROM generate_series(1995, 2000) AS g(y)) AS d
LEFT JOIN statements AS s ON s.ticker = l.ticker AND s.line_item = l.line_item AND s.statement = l.statement
  AND s.period_end = d.p""", r6=["value"]),
    "s2_current_price": build("""
SELECT ticker, coalesce(nullif(last_price, 0), nullif(alt_price, 0)) AS current_price FROM companies""", r6=["current_price"]),
    "s3_current_shares": build("SELECT ticker, nullif(shares_outstanding, 0) AS shares_outstanding FROM companies"),
    "s4_beta": build("""
SELECT symbol AS ticker, beta FROM positions LEFT JOIN companies ON ticker = symbol""", r6=["beta"]),
    "s5_sector": build("SELECT ticker, coalesce(nullif(trim(sector), ''), 'Unknown') AS sector FROM companies"),
    "s6_company_records": build("""
SELECT c.ticker, coalesce(nullif(last_price, 0), nullif(alt_price, 0)) AS current_price, shares_outstanding, beta,
  coalesce(nullif(sector, ''), 'Unknown') AS sector, i.revenue, i.ebit, i.pretax, i.tax_provision, i.interest,
  b.total_debt, b.cash, b.equity, f.ocf, f.capex, i.period_end AS income_period, b.period_end AS balance_period,
  f.period_end AS cash_flow_period
FROM companies AS c LEFT JOIN inc_now AS i ON i.ticker = c.ticker AND i.rn = 1
LEFT JOIN bal_now AS b ON b.ticker = c.ticker AND b.rn = 1 LEFT JOIN cfs_now AS f ON f.ticker = c.ticker AND f.rn = 1""",
        r6=["current_price", "beta"],
        r2=["revenue", "ebit", "pretax", "tax_provision", "interest", "total_debt", "cash", "equity", "ocf", "capex"]),
    "s7_normalise_tickers": "SELECT c_custkey, upper(trim(c_name)) AS ticker FROM customer WHERE c_custkey % 10 <> 0",
    "s8_risk_free_rate": build("""
SELECT as_of, risk_free FROM rf_at UNION ALL SELECT DATE '1990-01-01', 0.042e0""", r6=["risk_free"]),
    "s9_volatility_latest": build("""
SELECT close, date FROM macro_prices WHERE ticker = '^VIX' ORDER BY date DESC LIMIT 1""", r6=["close"]),
    "s10_headlines": build("SELECT ticker, pos, title, publisher, link, published_at FROM news_items WHERE title IS NOT NULL"),
    "s11_search_feed": build("""
SELECT ticker, pos, title, publisher, url AS link, 1700000000 + page_id AS published_at FROM news_items
WHERE title IS NOT NULL AND NOT nested"""),
    "s12_ticker_context": build("""
SELECT n.ticker, coalesce((SELECT arg_max(close, date) / 100e0 FROM macro_prices AS m WHERE m.ticker = '^RF'
    AND date BETWEEN DATE '2001-08-21' AND DATE '2001-08-31'), 0.042e0) AS risk_free,
  (SELECT arg_max(close, date) FROM macro_prices AS m WHERE m.ticker = '^VIX') AS vix,
  string_agg(n.title, '; ' ORDER BY n.pos) AS titles
FROM news_items AS n WHERE n.title IS NOT NULL GROUP BY n.ticker""", r6=["risk_free", "vix"]),
    "s13_xbrl_scan": build("SELECT ticker, tag, form, start, \"end\", val, accn, filed FROM xbrl_rows", r2=["val"]),
    "s14_registrant_ids": build("SELECT ticker, lpad((1000 + universe_pos)::VARCHAR, 10, '0') AS cik FROM companies"),
    "s15_snapshot_statements": build("SELECT ticker, statement, line_item, period_end, value FROM snap_statements", r2=["value"]),
    "s16_trade_log_sink": build("""
SELECT epoch_us(ts) AS ts, ticker, action, quantity, execution_price, wacc, beta, conviction_score, altman_z_score, var_95, cvar_95
FROM trade_logs""", r6=["quantity", "execution_price", "wacc", "beta", "conviction_score", "altman_z_score", "var_95", "cvar_95"]),
    "s17_curve_sink": build("SELECT date, strategy_value, benchmark_value FROM backtest_curve", r6=["strategy_value", "benchmark_value"]),
    "s18_schema_evolution": build("""
SELECT event_id, ticker, action, CASE WHEN event_id % 2 = 1 THEN altman_z_score END AS altman_z_score,
  CASE WHEN event_id % 2 = 1 THEN var_95 END AS var_95, CASE WHEN event_id % 2 = 1 THEN cvar_95 END AS cvar_95 FROM trade_logs""",
        r6=["altman_z_score", "var_95", "cvar_95"]),
    "s19_curve_read": build("""
SELECT date, strategy_value AS strategy, benchmark_value AS benchmark FROM backtest_curve ORDER BY date""", r6=["strategy", "benchmark"]),
    "s20_median_snapshot": build("""
SELECT '2001-07-01' AS generated_day, m.as_of, t.universe_size, t.tickers_used, r.risk_free AS risk_free_rate,
  0.025e0 AS terminal_growth, m.sector, m.sector_median AS median, m.sample_count
FROM medians AS m JOIN (SELECT as_of, count(*) AS universe_size, count(*) FILTER (skip_reason IS NULL) AS tickers_used
  FROM valuations GROUP BY 1) AS t ON t.as_of = m.as_of JOIN rf_at AS r ON r.as_of = m.as_of""", r6=["risk_free_rate", "median"]),
    "s21_hash_manifest": """
WITH a AS (SELECT 'doc-' || doc_id AS name, sha256(text) AS h, strlen(text) AS n FROM documents WHERE doc_id % 50 <> 1),
r AS (SELECT 'doc-' || doc_id AS name, CASE doc_id % 50 WHEN 3 THEN 'not-a-hash' WHEN 4 THEN sha256('other') ELSE sha256(text) END AS h,
  strlen(text) + CASE WHEN doc_id % 50 = 5 THEN 1 ELSE 0 END AS n FROM documents WHERE doc_id % 50 <> 2)
SELECT r.name, 'missing' AS problem FROM r ANTI JOIN a ON a.name = r.name
UNION ALL SELECT a.name, 'unlisted' FROM a ANTI JOIN r ON a.name = r.name
UNION ALL SELECT name, 'invalid_hash' FROM r WHERE NOT regexp_full_match(h, '[0-9a-f]{64}')
UNION ALL SELECT r.name, 'checksum_mismatch' FROM r JOIN a ON a.name = r.name WHERE a.h <> r.h
UNION ALL SELECT r.name, 'size_mismatch' FROM r JOIN a ON a.name = r.name WHERE a.n <> r.n""",
    "s22_position_feed": build("""
SELECT symbol, qty, CASE WHEN current_price % 7 <> 0 THEN market_value END AS "marketValue", current_price AS "currentPrice",
  avg_entry_price AS "avgEntryPrice", (current_price - avg_entry_price) * qty AS "unrealizedPl",
  (current_price - avg_entry_price) / avg_entry_price AS "unrealizedPlPercent" FROM positions""",
        r6=["qty", '"marketValue"', '"currentPrice"', '"avgEntryPrice"', '"unrealizedPl"', '"unrealizedPlPercent"']),
    "s23_open_order_symbols": build("""
SELECT DISTINCT symbol FROM (SELECT symbol, status, row_number() OVER (PARTITION BY order_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM order_events) WHERE rn = 1 AND status NOT IN ('filled', 'canceled', 'expired', 'rejected', 'done_for_day', 'stopped', 'suspended', 'calculated')"""),
    "s24_fresh_sentiment": build("""
SELECT ticker, title, seen_at FROM (SELECT ticker, title, 1700000000 + page_id AS seen_at,
    row_number() OVER (PARTITION BY ticker ORDER BY page_id DESC) AS rn
  FROM news_items WHERE title IS NOT NULL AND NOT nested AND 1700000000 + page_id > 1700000700 - 900 AND page_id <= 700) WHERE rn = 1"""),
    "s25_price_history": build("""
SELECT ticker, m::INTEGER AS months, count(*) AS closes, min(date) AS first_date, arg_max(close, date) AS last_close
FROM company_prices JOIN (VALUES (3, DATE '2001-03-30'), (12, DATE '2000-06-30')) AS w(m, since)
  ON date BETWEEN since AND DATE '2001-06-30' GROUP BY 1, 2""", r6=["last_close"]),
    "s26_snapshot_load": build("""
SELECT file_ticker, CASE WHEN NOT malformed THEN ticker END AS ticker,
  CASE WHEN malformed THEN 'malformed' WHEN ticker <> file_ticker THEN 'ticker_mismatch' ELSE 'ok' END AS status FROM snap"""),
}
