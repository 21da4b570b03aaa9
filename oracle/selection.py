from oracle.ctes import build

REQUESTS = """
SELECT ticker, universe_pos, CASE WHEN universe_pos % 4 <> 0 THEN (universe_pos % 60) / 100e0 - 0.15e0 END AS growth_request,
  CASE WHEN universe_pos % 3 <> 0 THEN (universe_pos % 70) / 100e0 END AS margin_request, (universe_pos % 8) / 100e0 AS terminal_request
FROM companies"""

KEY = b"an example key".ljust(64, b"\0")


def _blob(value: bytes) -> str:
    return "'" + "".join(f"\\x{b:02X}" for b in value) + "'::BLOB"


INNER, OUTER = (_blob(bytes(b ^ pad for b in KEY)) for pad in (0x36, 0x5C))

SQL = {
    "f1_line_item_lookup": build("""
SELECT ticker, period_end, revenue AS value, 'revenue' AS item FROM inc_now WHERE rn = 1
UNION ALL SELECT ticker, period_end, ebit, 'ebit' FROM inc_now WHERE rn = 1
UNION ALL SELECT ticker, period_end, cash, 'cash' FROM bal_now WHERE rn = 1
UNION ALL SELECT ticker, period_end, total_debt, 'total_debt' FROM bal_now WHERE rn = 1
UNION ALL SELECT ticker, period_end, ocf, 'ocf' FROM cfs_now WHERE rn = 1""", r2=["value"]),
    "f2_filing_lag": build("""
SELECT ticker, as_of, lag_days, count(*) AS visible_rows, max(period_end) AS newest_period
FROM statements JOIN (SELECT * FROM (VALUES (DATE '2000-03-30'), (DATE '2000-03-31'), (DATE '2000-06-30'), (DATE '2001-06-30')) AS d(as_of),
  (VALUES (90), (0)) AS l(lag_days)) ON period_end <= as_of - lag_days GROUP BY 1, 2, 3"""),
    "f3_zone_drop": """
SELECT event_id, ts::DATE AS day, hour(ts)::INTEGER AS hour, minute(ts)::INTEGER AS minute FROM events""",
    "f4_finite_numbers": """
SELECT event_id, CASE event_id % 7 WHEN 0 THEN true WHEN 6 THEN true ELSE false END AS usable FROM events""",
    "f5_capital_checks": """
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 AND c_acctbal > 0 THEN 'invalid_price' WHEN c_custkey % 7 = 0 THEN 'invalid_shares'
  WHEN c_custkey % 3 <> 0 AND c_acctbal < 0 THEN 'invalid_total_debt' WHEN c_custkey % 11 = 0 THEN 'invalid_cash' END AS problem FROM customer""",
    "f6_assumption_checks": build(f"""
SELECT ticker, CASE WHEN growth_request NOT BETWEEN -0.1e0 AND 0.4e0 THEN 'growth_out_of_range'
  WHEN margin_request NOT BETWEEN 0 AND 0.6e0 THEN 'margin_out_of_range'
  WHEN terminal_request NOT BETWEEN 0 AND 0.05e0 THEN 'terminal_growth_out_of_range' END AS problem FROM ({REQUESTS})"""),
    "f7_whole_numbers": """
SELECT p_partkey, CASE WHEN p_retailprice - 1000 >= 1 AND p_retailprice - 1000 = floor(p_retailprice - 1000)
  THEN (p_retailprice - 1000)::BIGINT END AS whole FROM part""",
    "f13_asset_split": build("""
SELECT CASE WHEN asset_class = 'us_equity' THEN 'equity' WHEN symbol LIKE 'SPY%' THEN 'hedge' ELSE 'other' END AS kind,
  count(*) AS positions, sum(market_value) AS market_value FROM positions GROUP BY 1""", r6=["market_value"]),
    "f14_duplicate_guard": build("""
SELECT ticker AS symbol FROM companies WHERE ticker NOT IN (
  SELECT symbol FROM (SELECT symbol, status, row_number() OVER (PARTITION BY order_id ORDER BY ts DESC, event_id DESC) AS rn
    FROM order_events) WHERE rn = 1 AND status NOT IN ('filled', 'rejected'))"""),
    "f18_safe_links": """
SELECT page_id, CASE WHEN page_id % 10 IN (0, 1) THEN NULL WHEN page_id % 10 = 2 THEN 'HTTPS://shout.example.org'
  WHEN regexp_matches(url, '^https?://.') THEN url END AS href FROM pages""",
    "f19_email_scan": """
SELECT doc_id, (pos - 1)::INTEGER AS match_pos, address FROM (
  SELECT doc_id, unnest(found) AS address, generate_subscripts(found, 1) AS pos FROM (
    SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}') AS found FROM documents))
WHERE lower(split_part(address, '@', 2)) NOT IN ('example.com', 'example.net', 'example.org')""",
    "f20_assumption_source": build(f"""
SELECT ticker, CASE WHEN growth_request IS NULL THEN 'historical' ELSE 'custom' END AS growth_source,
  CASE WHEN margin_request IS NULL THEN 'historical' ELSE 'custom' END AS margin_source FROM ({REQUESTS})"""),
    "f21_pseudonyms": f"""
SELECT c_custkey, sha256({OUTER} || unhex(sha256({INNER} || encode(lower(trim(c_name)))))) AS digest FROM customer""",
    "j1_as_of_price": build("SELECT ticker, as_of, price, price_date FROM price_at", r6=["price"]),
    "j1_as_of_price_dense": build("""
SELECT r.ticker, r.as_of, CASE WHEN p.date >= r.as_of - 10 THEN p.close END AS price,
  CASE WHEN p.date >= r.as_of - 10 THEN p.date END AS price_date
FROM (SELECT ticker, last_day(make_date(1995 + m // 12, 1 + m % 12, 1)) AS as_of FROM companies, range(84) AS g(m)) AS r
ASOF LEFT JOIN company_prices AS p ON p.ticker = r.ticker AND p.date <= r.as_of""", r6=["price"]),
    "j2_as_of_shares": build("SELECT ticker, as_of, shares, shares_approximated FROM shares_at", r6=["shares"]),
    "a1_split_factor": build("""
SELECT ticker, as_of, product(ratio) AS split_factor FROM splits
JOIN (VALUES (DATE '1999-01-01'), (DATE '2000-06-30'), (DATE '2001-06-30')) AS d(as_of) ON date > as_of GROUP BY 1, 2"""),
    "j11_scenario_grid": build("""
SELECT ticker, growth FROM companies, (VALUES (-0.1e0), (-0.05e0), (0e0), (0.05e0), (0.1e0), (0.2e0), (0.3e0), (0.4e0)) AS g(growth)"""),
    "w1_two_periods": build("""
SELECT c.ticker, c.as_of, c.period_end AS income_period, p.period_end AS income_prior_period, c.revenue,
  CASE WHEN p.period_end IS NULL THEN c.revenue ELSE p.revenue END AS prior_revenue, f_score
FROM two_inc AS c LEFT JOIN two_inc AS p ON p.ticker = c.ticker AND p.as_of = c.as_of AND p.rn = 2
JOIN f_scores AS s ON s.ticker = c.ticker AND s.as_of = c.as_of WHERE c.rn = 1 AND c.as_of <> DATE '2001-06-30'""", r2=["revenue", "prior_revenue"], big=["f_score"]),
}
