from oracle.ctes import build, cte
import oracle.scanning  # noqa: F401  (registers shared table expressions)

cte("thin_prices", """
SELECT * FROM prices WHERE NOT (ticker LIKE 'S%' AND TRY_CAST(substr(ticker, 2) AS INTEGER) % 7 = 3 AND date >= DATE '2000-06-30')
""")
cte("pick_bars", """
SELECT as_of, ticker, date_trunc('month', date)::DATE AS month, arg_max(close, date) AS close
FROM picks JOIN thin_prices USING (ticker) WHERE date >= as_of AND date <= DATE '2001-08-31' GROUP BY 1, 2, 3
""")
cte("index_bars", """
SELECT as_of, date_trunc('month', date)::DATE AS month, arg_max(close, date) AS close
FROM as_of_dates JOIN thin_prices ON ticker = 'IDX' AND date >= as_of AND date <= DATE '2001-08-31' GROUP BY 1, 2
""")
cte("shared", """
SELECT b.as_of, b.month, s.n AS survivors, i.close AS index_close FROM (SELECT as_of, month, count(*) AS n FROM pick_bars GROUP BY 1, 2) AS b
JOIN (SELECT as_of, count(DISTINCT ticker) AS n FROM pick_bars GROUP BY 1) AS s ON s.as_of = b.as_of AND s.n = b.n
JOIN index_bars AS i ON i.as_of = b.as_of AND i.month = b.month
""")
cte("curve", """
SELECT s.as_of, s.month, sum(100000e0 / s.survivors * (p.close / f.close)) AS strategy,
  max(100000e0 * (s.index_close / g.index_close)) AS benchmark, max(s.survivors) AS survivors
FROM shared AS s JOIN pick_bars AS p ON p.as_of = s.as_of AND p.month = s.month
JOIN (SELECT as_of, min(month) AS m FROM shared GROUP BY 1) AS z ON z.as_of = s.as_of
JOIN pick_bars AS f ON f.as_of = s.as_of AND f.ticker = p.ticker AND f.month = z.m
JOIN shared AS g ON g.as_of = s.as_of AND g.month = z.m GROUP BY 1, 2
""")
cte("forward", """
SELECT e.ticker, e.as_of, entry_price, entry_date, exit_price, exit_date, exit_price / entry_price - 1 AS total_return
FROM (SELECT ticker, as_of, arg_max(close, date) AS entry_price, max(date) AS entry_date FROM thin_prices
      JOIN as_of_dates ON date BETWEEN as_of - 10 AND as_of GROUP BY 1, 2) AS e
JOIN (SELECT ticker, arg_max(close, date) AS exit_price, max(date) AS exit_date FROM thin_prices
      WHERE date BETWEEN DATE '2001-08-21' AND DATE '2001-08-31' GROUP BY 1) AS x USING (ticker)
""")
cte("heads", """
SELECT d.as_of, CASE WHEN c.n >= 2 THEN c.s1 / c.s0 - 1 ELSE p.r END AS portfolio_return,
  CASE WHEN c.n >= 2 THEN c.b1 / c.b0 - 1 ELSE x.total_return END AS benchmark_return
FROM as_of_dates AS d LEFT JOIN (SELECT as_of, count(*) AS n, arg_min(strategy, month) AS s0, arg_max(strategy, month) AS s1,
    arg_min(benchmark, month) AS b0, arg_max(benchmark, month) AS b1 FROM curve GROUP BY 1) AS c ON c.as_of = d.as_of
LEFT JOIN (SELECT k.as_of, avg(total_return) AS r FROM picks AS k JOIN forward AS f ON f.ticker = k.ticker AND f.as_of = k.as_of GROUP BY 1) AS p ON p.as_of = d.as_of
LEFT JOIN forward AS x ON x.ticker = 'IDX' AND x.as_of = d.as_of
""")
cte("regions", """
SELECT r.ticker, r.date, r.close AS strategy, i.close AS benchmark FROM region_prices AS r
JOIN macro_prices AS i ON i.ticker = 'IDX' AND i.date = r.date
""")
cte("steps", """
SELECT ticker, date, strategy, benchmark, strategy / lag(strategy) OVER w - 1 AS strategy_return, ln(strategy / lag(strategy) OVER w) AS strategy_log_return,
  benchmark / lag(benchmark) OVER w - 1 AS benchmark_return, ln(benchmark / lag(benchmark) OVER w) AS benchmark_log_return,
  max(strategy) OVER w AS strategy_peak, max(benchmark) OVER w AS benchmark_peak
FROM regions WINDOW w AS (PARTITION BY ticker ORDER BY date)
""")
STEP = ["strategy", "benchmark", "strategy_return", "strategy_log_return", "benchmark_return", "benchmark_log_return"]
DROP = "max((strategy_peak - strategy) / strategy_peak) * 100"
DROP_B = "max((benchmark_peak - benchmark) / benchmark_peak) * 100"
WIN = "100e0 * count(*) FILTER (strategy_return > benchmark_return) / count(strategy_return)"

SQL = {
    "w6_monthly_bars": build("SELECT ticker, date_trunc('month', date)::DATE AS month, arg_max(close, date) AS close FROM company_prices GROUP BY 1, 2", r6=["close"]),
    "w7_equity_curve": build("SELECT * FROM curve", r6=["strategy", "benchmark"]),
    "w7_dropped_picks": build("SELECT as_of, ticker FROM picks AS k WHERE NOT EXISTS (SELECT 1 FROM pick_bars AS b WHERE b.as_of = k.as_of AND b.ticker = k.ticker)"),
    "w8_forward_performance": build("""
SELECT e.ticker, e.as_of, e.price AS entry_price, e.price_date AS entry_date, x.c AS exit_price, x.d AS exit_date, x.c / e.price - 1 AS total_return
FROM price_at AS e JOIN (SELECT ticker, arg_max(close, date) AS c, max(date) AS d FROM company_prices
  WHERE date BETWEEN DATE '2001-08-21' AND DATE '2001-08-31' GROUP BY 1) AS x ON x.ticker = e.ticker""", r6=["entry_price", "exit_price", "total_return"]),
    "w9_max_drawdown": build(f"SELECT ticker, {DROP} AS strategy_max_drawdown, {DROP_B} AS benchmark_max_drawdown FROM steps GROUP BY 1",
        r6=["strategy_max_drawdown", "benchmark_max_drawdown"]),
    "w10_period_returns": build(f"SELECT ticker, date, {', '.join(STEP)} FROM steps", r6=STEP),
    "w11_curve_metrics": build(f"""
SELECT ticker, points, strategy_total, benchmark_total, strategy_annual, benchmark_annual, strategy_annual - benchmark_annual AS alpha, volatility,
  (strategy_annual / 100 - 0.045e0) / (volatility / 100) AS sharpe, max_drawdown, benchmark_max_drawdown, win_rate
FROM (SELECT ticker, count(*) AS points, (arg_max(strategy, date) / arg_min(strategy, date) - 1) * 100 AS strategy_total,
  (arg_max(benchmark, date) / arg_min(benchmark, date) - 1) * 100 AS benchmark_total,
  (pow(arg_max(strategy, date) / arg_min(strategy, date), 365.25e0 / (max(date) - min(date))) - 1) * 100 AS strategy_annual,
  (pow(arg_max(benchmark, date) / arg_min(benchmark, date), 365.25e0 / (max(date) - min(date))) - 1) * 100 AS benchmark_annual,
  stddev_samp(strategy_log_return) * sqrt(365.25e0 / ((max(date) - min(date)) / (count(*) - 1))) * 100 AS volatility,
  {DROP} AS max_drawdown, {DROP_B} AS benchmark_max_drawdown, {WIN} AS win_rate FROM steps GROUP BY 1)""",
        r6=["strategy_total", "benchmark_total", "strategy_annual", "benchmark_annual", "alpha", "volatility", "sharpe", "max_drawdown",
            "benchmark_max_drawdown", "win_rate"]),
    "w12_win_rate": build(f"SELECT ticker, {WIN} AS win_rate FROM steps GROUP BY 1", r6=["win_rate"]),
    "j5_common_months": build("SELECT as_of, month, survivors FROM shared"),
    "a12_headline_returns": build("SELECT *, portfolio_return - benchmark_return AS alpha FROM heads", r6=["portfolio_return", "benchmark_return", "alpha"]),
    "p12_backtest": build("""
SELECT h.*, portfolio_return - benchmark_return AS alpha, k.n AS picks, d.dropped FROM heads AS h
LEFT JOIN (SELECT as_of, count(*) AS n FROM picks GROUP BY 1) AS k ON k.as_of = h.as_of
LEFT JOIN (SELECT as_of, string_agg(ticker, ',' ORDER BY ticker) AS dropped FROM picks AS p
  WHERE NOT EXISTS (SELECT 1 FROM pick_bars AS b WHERE b.as_of = p.as_of AND b.ticker = p.ticker) GROUP BY 1) AS d ON d.as_of = h.as_of""",
        r6=["portfolio_return", "benchmark_return", "alpha"]),
    "u1_shared_months": build("""
SELECT month FROM (SELECT DISTINCT ticker, date_trunc('month', date)::DATE AS month FROM (SELECT * FROM region_prices
  UNION ALL SELECT * FROM macro_prices WHERE ticker = 'IDX')) GROUP BY 1 HAVING count(*) = 6"""),
}
