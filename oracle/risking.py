from oracle.ctes import build, cte
from oracle.planning import put_price
from oracle.normal import normal_cdf_sql

cte("risk_prices", "SELECT * FROM region_prices UNION ALL SELECT * FROM macro_prices WHERE ticker = 'IDX'")
for _name, _source in (("returns", "risk_prices"), ("company_returns", "company_prices"), ("all_returns", "prices")):
    cte(_name, f"""
SELECT ticker, date, r FROM (SELECT ticker, date, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY date)) AS r FROM (
  SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS age FROM {_source} WHERE date <= DATE '2001-06-30') WHERE age <= 252)
WHERE r IS NOT NULL
""")
cte("holdings", """
SELECT 'P' || n_nationkey AS portfolio_id, 'R_' || r_name AS ticker, ((n_nationkey + i) % 4) / 10e0 AS weight
FROM nation, (VALUES ('AFRICA', 0), ('AMERICA', 1), ('ASIA', 2), ('EUROPE', 3), ('MIDDLE EAST', 4)) AS v(r_name, i) WHERE n_nationkey % 6 <> 5
UNION ALL SELECT 'P' || n_nationkey, 'UNPRICED', (n_nationkey % 10) / 5e0 FROM nation WHERE n_nationkey % 6 <> 5
UNION ALL SELECT 'P' || n_nationkey, CASE WHEN n_nationkey % 12 = 5 THEN 'IDX' ELSE 'UNPRICED' END, 0.9e0 FROM nation WHERE n_nationkey % 6 = 5
""")
cte("held", """
SELECT h.portfolio_id, h.ticker, h.weight, r.date, r.r FROM holdings AS h JOIN returns AS r ON r.ticker = h.ticker
QUALIFY count(*) OVER (PARTITION BY h.portfolio_id, r.date) =
  (SELECT count(DISTINCT x.ticker) FROM holdings AS x WHERE x.portfolio_id = h.portfolio_id AND x.ticker IN (SELECT ticker FROM returns))
""")
cte("complete", """
SELECT * FROM returns WHERE date IN (SELECT date FROM returns GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT ticker) FROM returns))
""")
cte("some_returns", """
SELECT * FROM returns WHERE ticker IN (SELECT ticker FROM companies WHERE sector = (SELECT min(sector) FROM companies))
""")
cte("some_days", """
SELECT * FROM some_returns WHERE date IN (SELECT date FROM some_returns GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT ticker) FROM some_returns))
""")
cte("policy", """
SELECT *, CASE WHEN priced_names = 0 THEN 'no_history' WHEN observations < 2 THEN 'no_overlap' WHEN priced_weight <= 0 THEN 'no_priced_weight'
  WHEN priced_weight / total_weight < 0.5e0 THEN 'low_coverage' END AS message
FROM (SELECT h.portfolio_id, sum(weight) AS total_weight, sum(CASE WHEN p THEN weight ELSE 0e0 END) AS priced_weight, count(*) FILTER (p) AS priced_names,
    max(coalesce(o.n, 0)) AS observations
  FROM (SELECT *, ticker IN (SELECT ticker FROM returns) AS p FROM holdings) AS h
  LEFT JOIN (SELECT portfolio_id, count(DISTINCT date) AS n FROM held GROUP BY 1) AS o ON o.portfolio_id = h.portfolio_id GROUP BY 1)
""")


def mixed(table: str, col: str) -> str:
    """The table with the column's 32-bit numbers mixed, in five steps."""
    low = "4294967295::UBIGINT"
    for step in (f"xor({col}, {col} >> 16)", f"({col} * 2146121005::UBIGINT) & {low}", f"xor({col}, {col} >> 15)",
                 f"({col} * 2221713035::UBIGINT) & {low}", f"xor({col}, {col} >> 16)"):
        table = f"(SELECT * REPLACE ({step} AS {col}) FROM {table})"
    return table


_SEED = mixed("(SELECT 7::UBIGINT AS s)", "s")
_PATHS = mixed(f"(SELECT i AS path, (i + s) & 4294967295::UBIGINT AS a FROM (SELECT i::UBIGINT AS i FROM range(10000) AS r(i)), {_SEED})", "a")
_DAYS = mixed("(SELECT i, i::UBIGINT AS b FROM range(504) AS r(i))", "b")
_PAIRS = f"(SELECT path, x.i // 2 AS day, xor(a, x.b) AS h, xor(a, y.b) AS g FROM {_PATHS}, {_DAYS} AS x JOIN {_DAYS} AS y ON y.i = x.i + 1 WHERE x.i % 2 = 0)"
cte("draws", f"""
SELECT path, day, sqrt(-2e0 * ln((h + 0.5e0) / 4294967296e0)) * cos(2e0 * pi() * ((g + 0.5e0) / 4294967296e0)) AS z
FROM {mixed(mixed(_PAIRS, "h"), "g")}
""")
cte("columns", """
SELECT h.portfolio_id, h.ticker, h.weight * (total_weight / priced_weight) AS weight, r - avg(r) OVER one AS off, avg(r) OVER one AS mean,
  dense_rank() OVER (PARTITION BY h.portfolio_id ORDER BY date) - 1 AS day, count(*) OVER one AS days
FROM held AS h JOIN policy AS p ON p.portfolio_id = h.portfolio_id WHERE message IS NULL WINDOW one AS (PARTITION BY h.portfolio_id, h.ticker)
""")
cte("paths", """
SELECT portfolio_id, path, sum(weight * (exp(spread) - 1)) AS r FROM (
  SELECT portfolio_id, ticker, path, any_value(weight) AS weight, sum(z * off) * sqrt(21e0 / (any_value(days) - 1)) + 21 * any_value(mean) AS spread
  FROM columns AS c JOIN draws AS d ON d.day = c.day GROUP BY 1, 2, 3) GROUP BY 1, 2
""")
cte("simulated", """
SELECT p.portfolio_id, CASE WHEN message IS NULL THEN 'ok' ELSE 'insufficient_data' END AS status, message, var_95, cvar_95
FROM policy AS p LEFT JOIN (
  SELECT portfolio_id, max(v) AS var_95, avg(r) FILTER (r <= v) AS cvar_95
  FROM paths JOIN (SELECT portfolio_id, quantile_cont(r, 0.05) AS v FROM paths GROUP BY 1) USING (portfolio_id) GROUP BY 1) AS t USING (portfolio_id)
""")
STRESSED = "(98.5e0 * (1 - 0.07e0))"
SPOT, K, T, R, V = "98.5e0", "strike_price", "years", "0.04e0", "0.15e0"
D1 = f"((ln({SPOT} / {K}) + ({R} + 0.5e0 * {V} * {V}) * {T}) / ({V} * sqrt({T})))"
CHAIN = "(SELECT *, (expiration_date - DATE '2001-06-30') / 365e0 AS years FROM option_chain WHERE expiration_date > DATE '2001-06-30')"

SQL = {
    "w3_log_returns": build("SELECT * FROM company_returns", r6=["r"]),
    "v3_usable_history": build("SELECT ticker, count(*) AS returns, min(date) AS first_date FROM all_returns GROUP BY 1"),
    "a7_return_stats": build("SELECT ticker, count(*) AS n, avg(r) AS mean, stddev_samp(r) AS std FROM company_returns GROUP BY 1", r6=["mean", "std"]),
    "j4_complete_dates": build("SELECT * FROM complete", r6=["r"]),
    "j7_holdings_returns": build("SELECT * FROM held", r6=["weight", "r"]),
    "a8_covariance": build("""
SELECT a.ticker AS ticker_1, b.ticker AS ticker_2, covar_samp(a.r, b.r) * 1e4 AS covariance FROM complete AS a JOIN complete AS b ON b.date = a.date AND a.ticker <= b.ticker
GROUP BY 1, 2""", r6=["covariance"]),
    "a8_mean_vector": build("SELECT ticker, avg(r) * 1e2 AS mean FROM complete GROUP BY 1", r6=["mean"]),
    "a8_sector_covariance": build("""
SELECT a.ticker AS ticker_1, b.ticker AS ticker_2, covar_samp(a.r, b.r) * 1e4 AS covariance FROM some_days AS a
JOIN some_days AS b ON b.date = a.date AND a.ticker <= b.ticker GROUP BY 1, 2""", r6=["covariance"]),
    "a9_tail_risk": build("""
SELECT o_orderpriority AS portfolio_id, 'ok' AS status, max(v) AS var_95, avg(r) FILTER (r <= v) AS cvar_95
FROM (SELECT o_orderpriority, (o_totalprice - 250000e0) / 1e6 AS r FROM orders) JOIN (
  SELECT o_orderpriority, quantile_cont((o_totalprice - 250000e0) / 1e6, 0.05) AS v FROM orders GROUP BY 1) USING (o_orderpriority) GROUP BY 1""", r6=["var_95", "cvar_95"]),
    "v1_weight_policy": build("""
SELECT h.portfolio_id, h.ticker, h.weight * (total_weight / priced_weight) AS weight FROM holdings AS h JOIN policy AS p ON p.portfolio_id = h.portfolio_id
WHERE message IS NULL AND h.ticker IN (SELECT ticker FROM returns)""", r6=["weight"]),
    "v2_status_ladder": build("""
SELECT portfolio_id, total_weight, priced_weight, priced_names, priced_weight / nullif(total_weight, 0) AS coverage, observations,
  CASE WHEN message IS NULL THEN 'ok' ELSE 'insufficient_data' END AS status, message FROM policy""", r6=["total_weight", "priced_weight", "coverage"]),
    "v4_single_asset_simulation": build("""
SELECT s.* FROM simulated AS s SEMI JOIN (SELECT portfolio_id FROM holdings WHERE ticker = 'IDX') AS one USING (portfolio_id)""", r6=["var_95", "cvar_95"]),
    "v5_simulated_paths": build("SELECT portfolio_id, path::BIGINT AS path, r FROM paths", r6=["r"]),
    "v6_portfolio_var": build("SELECT * FROM simulated", r6=["var_95", "cvar_95"]),
    "v7_put_pricing": build(f"""
SELECT symbol, {D1} AS d1, {D1} - {V} * sqrt({T}) AS d2, {put_price(SPOT, K, T, R, V)} AS put_price, {normal_cdf_sql(D1)} - 1 AS put_delta FROM {CHAIN}""",
        r6=["d1", "d2", "put_price", "put_delta"]),
    "v8_stress_payoff": build(f"""
SELECT symbol, {put_price(STRESSED, K, T, R, V)} AS stressed_put_price,
  ({put_price(STRESSED, K, T, R, V)} - {put_price(SPOT, K, T, R, V)}) * 100 AS payoff FROM {CHAIN}""",
        r6=["stressed_put_price", "payoff"]),
    "v9_contract_sizing": build(f"""
SELECT c_custkey, CASE WHEN c_custkey % 17 = 0 OR c_acctbal <= 0 OR days < 1 OR payoff <= 0 OR budget <= 0 THEN 0
  ELSE greatest(0, least(50, ceil(c_acctbal / payoff), coalesce(floor(budget / (put * 100)), 50))) END::BIGINT AS contracts
FROM (SELECT *, ({put_price("(580e0 * (1 - 0.07e0))", "strike", "years", "0.04e0", "0.15e0")} - put) * 100 AS payoff FROM (
  SELECT *, {put_price("580e0", "strike", "years", "0.04e0", "0.15e0")} AS put FROM (
    SELECT c_custkey, c_acctbal, 540e0 + c_custkey % 80 AS strike, c_custkey % 45 AS days, greatest(c_custkey % 45, 1) / 365e0 AS years,
      CASE WHEN c_custkey % 4 <> 0 THEN 300e0 * (c_custkey % 20) END AS budget FROM customer)))"""),
}
