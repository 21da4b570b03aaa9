from oracle.ctes import build, cte
from oracle.normal import normal_cdf_sql
import oracle.scanning  # noqa: F401  (registers shared table expressions)

cte("portfolio_picks", """
SELECT industry AS portfolio_id, ticker, sector, beta, row_number() OVER (PARTITION BY industry ORDER BY universe_pos) AS pick_rank FROM companies
""")
cte("targets", "SELECT ticker FROM companies WHERE beta <= 1 OR beta IS NULL")
cte("weights", """
SELECT *, raw / sum(raw) OVER (PARTITION BY portfolio_id) AS weight
FROM (SELECT *, 1e0 / CASE WHEN coalesce(beta, 1e0) < 0.5e0 THEN 0.5e0 ELSE coalesce(beta, 1e0) END AS raw FROM portfolio_picks)
""")
cte("spread_cases", """
SELECT portfolio_id || ' ' || kind AS portfolio_id, ticker, amount, CASE kind WHEN 'high' THEN weight * 1.5e0 WHEN 'empty' THEN 0e0
  WHEN 'gaps' THEN CASE WHEN pick_rank % 2 = 1 THEN 0e0 ELSE weight / 2 END ELSE weight / 2 END AS weight
FROM weights, (VALUES ('half', 0.5e0), ('high', 0.2e0), ('gaps', 0.6e0), ('empty', 0.1e0), ('negative', -0.1e0)) AS k(kind, amount)
""")
cte("rebalance", """
SELECT *, CASE WHEN abs(current_notional / 100000e0 - weight) <= 0.03e0 THEN 'within_drift' WHEN abs(raw_order) < 1 THEN 'below_minimum' ELSE 'pending' END AS status,
  CASE WHEN raw_order >= 0 THEN 'buy' ELSE 'sell' END AS side, raw_order AS order_notional
FROM (SELECT w.*, 100000e0 * w.weight AS target_notional, coalesce(p.market_value, 0e0) AS current_notional,
    100000e0 * w.weight - coalesce(p.market_value, 0e0) AS raw_order FROM weights AS w LEFT JOIN positions AS p ON p.symbol = w.ticker)
""")
cte("post_fill", """
SELECT symbol, sector, CASE WHEN over_cap THEN market_value - 15000e0 ELSE 0e0 END AS excess,
  CASE WHEN NOT over_cap OR trimmed IS NULL THEN market_value / 100000e0
    WHEN rest <= 15000e0 + 0.010001e0 THEN least(rest / 100000e0, 0.15e0) ELSE rest / 100000e0 END AS weight,
  NOT over_cap OR coalesce(rest <= 15000e0 + 0.010001e0, false) AS resolved
FROM (SELECT *, CASE WHEN trimmed IS NOT NULL THEN greatest(market_value - trimmed, 0) END AS rest FROM (
  SELECT p.symbol, coalesce(c.sector, 'Unknown') AS sector, p.market_value, p.market_value / 100000e0 > 0.15e0 + 1e-9 AS over_cap,
    CASE c.universe_pos % 3 WHEN 1 THEN p.market_value - 0.15e0 * 100000 WHEN 2 THEN (p.market_value - 0.15e0 * 100000) / 2 END AS trimmed
  FROM positions AS p LEFT JOIN companies AS c ON c.ticker = p.symbol WHERE p.asset_class = 'us_equity'))
""")
cte("polled", """
SELECT e.*, epoch_us(ts) - s.start AS since, status IN ('filled', 'rejected') AS done FROM order_events AS e
JOIN (SELECT order_id, min(epoch_us(ts)) AS start FROM order_events GROUP BY 1) AS s ON s.order_id = e.order_id
WHERE epoch_us(ts) - s.start <= 9 * 3 * 86400000000
""")
cte("resolved_orders", """
SELECT *, done AS resolved, CASE WHEN done THEN (since + 3 * 86400000000 - 1) // (3 * 86400000000) + 1 ELSE 10 END AS poll
FROM polled QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY NOT done,
  CASE WHEN done THEN ts END, CASE WHEN done THEN event_id END, ts DESC, event_id DESC) = 1
""")
cte("spot", """
SELECT d.as_of, (SELECT arg_max(close, date) FROM macro_prices WHERE ticker = 'IDX' AND date BETWEEN d.as_of - 10 AND d.as_of) AS spot
FROM as_of_dates AS d WHERE d.as_of = DATE '2001-06-30'
""")
cte("chosen", """
SELECT 'SPY' AS underlying, as_of, symbol, expiration_date, strike_price, spot FROM option_chain, spot
WHERE tradable AND abs(expiration_date - (as_of + 30)) <= 10 AND strike_price BETWEEN round(spot * 0.9e0, 2) AND round(spot * 1.1e0, 2)
ORDER BY abs(expiration_date - (as_of + 30)), abs(strike_price - spot), chain_pos LIMIT 1
""")
cte("hedge_positions", """
SELECT 'SPY' || lpad(p_partkey::VARCHAR, 7, '0') AS symbol, CASE WHEN p_partkey % 5 = 0 THEN 'us_equity' ELSE 'us_option' END AS asset_class,
  1e0 + p_partkey % 2 AS qty, 0.001e0 * (1 + p_partkey % 3) AS market_value FROM part
""")
cte("exposure", """
SELECT c.underlying, c.as_of, coalesce(sum(qty) FILTER (h.symbol = c.symbol), 0e0) AS matching_qty,
  coalesce(sum(market_value) FILTER (h.symbol = c.symbol), 0e0) AS matching_value, coalesce(sum(qty) FILTER (h.symbol <> c.symbol), 0e0) AS other_qty,
  coalesce(sum(market_value) FILTER (h.symbol <> c.symbol), 0e0) AS other_value
FROM hedge_positions AS h, chosen AS c WHERE asset_class = 'us_option' GROUP BY 1, 2
""")


def put_price(s: str, k: str, t: str, r: str, v: str) -> str:
    d1 = f"((ln({s} / {k}) + ({r} + 0.5e0 * {v} * {v}) * {t}) / ({v} * sqrt({t})))"
    a, b = f"(-{d1})", f"(-({d1} - {v} * sqrt({t})))"
    return f"({k} * exp(-{r} * {t}) * {normal_cdf_sql(b)} - {s} * {normal_cdf_sql(a)})"


cte("put_now", f"""
SELECT *, ({put_price("spot * (1 - 0.07e0)", "strike_price", "years", "0.04e0", "0.15e0")} - put_price) * 100 AS payoff
FROM (SELECT *, {put_price("spot", "strike_price", "years", "0.04e0", "0.15e0")} AS put_price
  FROM (SELECT *, (expiration_date - as_of)::BIGINT AS days, (expiration_date - as_of) / 365e0 AS years FROM chosen))
""")

QTY = "format(' (qty={:.2f})', filled_qty)"


def label(full: str, part: str) -> str:
    return f"""CASE WHEN status = 'rejected' THEN 'REJECTED' WHEN filled_qty <= 0 THEN 'PENDING (status=' || status || ')'
  WHEN status = 'filled' THEN '{full}' ELSE '{part}' || {QTY} END"""


SQL = {
    "p1_inverse_beta_weights": build("SELECT portfolio_id, ticker, pick_rank::INTEGER AS pick_rank, weight FROM weights", r6=["weight"]),
    "p2_capped_distribution": build("""
WITH RECURSIVE pouring AS (
  SELECT portfolio_id, ticker, weight AS before, weight, amount AS remaining, true AS active, 0 AS round FROM spread_cases
  UNION ALL
  SELECT portfolio_id, ticker, before, weight + give, coalesce(sum(share - give) FILTER (WHERE capped) OVER (PARTITION BY portfolio_id), 0e0),
    active AND NOT capped, round + 1
  FROM (SELECT *, least(share, greatest(0.15e0 - weight, 0e0)) AS give, active AND least(share, greatest(0.15e0 - weight, 0e0)) < share - 1e-9 AS capped
    FROM (SELECT *, CASE WHEN NOT active THEN 0e0 WHEN pool > 0 THEN remaining * (weight / pool) ELSE remaining / n END AS share
      FROM (SELECT *, sum(weight) FILTER (WHERE active) OVER (PARTITION BY portfolio_id) AS pool,
          count(*) FILTER (WHERE active) OVER (PARTITION BY portfolio_id) AS n FROM pouring WHERE remaining > 1e-9) WHERE n > 0)))
SELECT portfolio_id, ticker, any_value(before) AS weight, arg_max(weight, round) AS new_weight FROM pouring GROUP BY portfolio_id, ticker""",
        r6=["weight", "new_weight"]),
    "p3_capped_weights": build("""
WITH RECURSIVE mixed AS (
  SELECT portfolio_id, ticker, sector, beta, pick_rank::INTEGER AS pick_rank FROM portfolio_picks
  UNION ALL SELECT 'mixed ' || (universe_pos % 40)::VARCHAR, ticker, sector, beta, universe_pos::INTEGER FROM companies
), started AS (
  SELECT *, raw / sum(raw) OVER (PARTITION BY portfolio_id) AS weight
  FROM (SELECT *, 1e0 / greatest(coalesce(beta, 1e0), 0.5e0) AS raw FROM mixed)
), steps AS (
  SELECT portfolio_id, ticker, sector, pick_rank, weight, 0 AS step, true AS moved, true AS live FROM started
  UNION ALL
  SELECT portfolio_id, ticker, sector, pick_rank,
    CASE WHEN into_it AND amount > 0 THEN greatest(base, least(0.15e0, coalesce(level * base, 0.15e0))) ELSE base END, step + 1,
    CASE WHEN step % 2 = 0 THEN amount > 0 ELSE moved END, step % 2 = 0 OR moved OR amount > 0
  FROM (
    SELECT *, min(CASE WHEN into_it AND try_level * base <= 0.15e0 THEN {'ahead': ahead, 'level': try_level} END)
        OVER (PARTITION BY portfolio_id).level AS level
    FROM (
      SELECT *, (sum(base) FILTER (WHERE into_it) OVER whole + amount - 0.15e0 * ahead) /
        sum(base) OVER (PARTITION BY portfolio_id, into_it ORDER BY base DESC, ticker ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS try_level
      FROM (
        SELECT *, sum(extra) OVER (PARTITION BY portfolio_id) AS amount,
          row_number() OVER (PARTITION BY portfolio_id, into_it ORDER BY base DESC, ticker) - 1 AS ahead
        FROM (
          SELECT *,
            CASE WHEN step % 2 = 0 THEN least(weight, CASE WHEN tall THEN 0.15e0 ELSE weight END)
              WHEN total > 0.250000001e0 THEN weight * 0.25e0 / total ELSE weight END AS base,
            CASE WHEN step % 2 = 0 THEN NOT tall ELSE total < 0.249999999e0 END AS into_it,
            CASE WHEN step % 2 = 0 THEN CASE WHEN tall THEN weight - 0.15e0 ELSE 0e0 END
              WHEN total > 0.250000001e0 THEN weight - weight * 0.25e0 / total ELSE 0e0 END AS extra
          FROM (SELECT *, weight > 0.150000001e0 AS tall, sum(weight) OVER (PARTITION BY portfolio_id, coalesce(sector, 'Unknown')) AS total
            FROM steps WHERE live AND step < 40))) WINDOW whole AS (PARTITION BY portfolio_id))))
SELECT portfolio_id, ticker, any_value(sector) AS sector, any_value(pick_rank) AS pick_rank, arg_max(weight, step) AS weight
FROM steps GROUP BY portfolio_id, ticker""", r6=["weight"]),
    "a10_sector_totals": build("""
SELECT portfolio_id, coalesce(sector, 'Unknown') AS sector, sum(weight) AS sector_weight, sum(weight) > 0.25e0 + 1e-9 AS breach FROM weights GROUP BY 1, 2""", r6=["sector_weight"]),
    "p4_liquidation_plan": build("""
SELECT symbol, qty, market_value, reason FROM (SELECT p.*, CASE WHEN symbol NOT IN (SELECT ticker FROM targets) THEN 'left_targets'
    WHEN current_price >= intrinsic_value THEN 'profit_taking' END AS reason
  FROM positions AS p LEFT JOIN valuations AS v ON v.ticker = p.symbol AND v.as_of = DATE '2001-06-30' WHERE asset_class = 'us_equity')
WHERE reason IS NOT NULL""", r6=["qty", "market_value"]),
    "p5_rebalance_plan": build("SELECT portfolio_id, ticker, side, target_notional, current_notional, order_notional, status FROM rebalance",
        r6=["target_notional", "current_notional", "order_notional"]),
    "p6_cent_allocation": build("""
WITH RECURSIVE sized AS (SELECT r.*, t.total > 33333.33e0 + 1e-9 AND pend AS scaled,
    CASE WHEN pend AND t.total > 33333.33e0 + 1e-9 THEN order_notional * (33333.33e0 / t.total) ELSE order_notional END AS ideal
  FROM (SELECT *, status = 'pending' AND side = 'buy' AS pend FROM rebalance) AS r
  JOIN (SELECT portfolio_id, sum(CASE WHEN status = 'pending' AND side = 'buy' THEN order_notional ELSE 0 END) AS total FROM rebalance GROUP BY 1) AS t
    ON t.portfolio_id = r.portfolio_id),
spend AS (
  SELECT portfolio_id, 0::BIGINT AS pick_rank, 0::BIGINT AS given, 3333333::BIGINT AS cash FROM sized GROUP BY 1
  UNION ALL SELECT s.portfolio_id, s.pick_rank, CASE WHEN s.pend THEN least(floor(s.ideal::DECIMAL(30,12) * 100)::BIGINT, p.cash) ELSE 0 END,
    p.cash - CASE WHEN s.pend THEN least(floor(s.ideal::DECIMAL(30,12) * 100)::BIGINT, p.cash) ELSE 0 END
  FROM spend AS p JOIN sized AS s ON s.portfolio_id = p.portfolio_id AND s.pick_rank = p.pick_rank + 1)
SELECT s.portfolio_id, s.ticker, s.side, round(CASE WHEN pend THEN given / 100e0 ELSE ideal END, 6) + 0e0 AS order_notional, scaled,
  CASE WHEN status <> 'pending' THEN status WHEN scaled AND given < 100 THEN 'unaffordable' WHEN pend AND scaled THEN 'would_buy_scaled'
    WHEN pend THEN 'would_buy' ELSE 'would_sell' END AS status
FROM sized AS s JOIN spend AS p ON p.portfolio_id = s.portfolio_id AND p.pick_rank = s.pick_rank"""),
    "p7_post_fill_check": build("SELECT * FROM post_fill", r6=["excess", "weight"]),
    "p7_caps_resolved": build("""
SELECT p AS positions_ok, s AS sector_breach, p AND NOT s AS resolved FROM (SELECT (SELECT bool_and(resolved) FROM post_fill) AS p,
  (SELECT bool_or(w > 0.25e0 + 1e-9) FROM (SELECT sum(weight) AS w FROM post_fill GROUP BY sector)) AS s)"""),
    "p8_fill_labels": build(f"""
SELECT order_id, {label("LIQUIDATED", "PARTIALLY_LIQUIDATED")} AS liquidation, {label("ORDER FILLED", "PARTIALLY FILLED")} AS rebalance FROM resolved_orders"""),
    "p9_holdings_weights": build("SELECT symbol AS ticker, market_value / 100000e0 AS weight FROM positions WHERE asset_class = 'us_equity'", r6=["weight"]),
    "j8_positions_against_targets": build("""
SELECT symbol, 'left_targets' AS kind, market_value FROM positions WHERE symbol NOT IN (SELECT ticker FROM targets)
UNION ALL SELECT ticker, 'target', coalesce(market_value, 0) FROM targets LEFT JOIN positions ON symbol = ticker""", r6=["market_value"]),
    "j9_exits_not_rebought": build("""
SELECT ticker FROM companies WHERE ticker NOT IN (SELECT symbol FROM resolved_orders WHERE status = 'filled' AND filled_qty > 0)"""),
    "j10_nearest_contract": build("SELECT * FROM chosen", r6=["strike_price", "spot"]),
    "a11_hedge_exposure": build("SELECT * FROM exposure", r6=["matching_qty", "matching_value", "other_qty", "other_value"]),
    "p10_hedge_plan": build("""
SELECT portfolio_id, symbol, strike_price AS strike, days::INTEGER AS days, put_price, payoff, budget, target_contracts,
  CASE WHEN target_contracts > 0 THEN greatest(trunc(target_contracts - matching_qty), 0)::BIGINT ELSE 0 END AS contracts_to_buy,
  CASE WHEN c % 17 = 0 THEN 'no_quote' WHEN c % 19 = 0 THEN 'no_contract' END AS reason
FROM (SELECT *, CASE WHEN symbol IS NOT NULL AND var_dollars > 0 AND payoff > 0 AND budget > 0 THEN greatest(0, least(ceil(var_dollars / payoff), floor(budget / (put_price * 100)), 50)) ELSE 0 END::BIGINT AS target_contracts
  FROM (SELECT r.*, p.*, e.matching_qty, CASE WHEN c % 3 <> 0 THEN least(greatest(0.02e0 * equity - coalesce(matching_value + other_value, 0), 0), 0.01e0 * equity * (c % 5))
      ELSE greatest(0.02e0 * equity - coalesce(matching_value + other_value, 0), 0) END AS budget
    FROM (SELECT c_custkey AS c, c_name AS portfolio_id, 50000e0 + 1000e0 * (c_custkey % 100) AS equity, c_acctbal AS var_dollars,
        c_custkey % 17 <> 0 AND c_custkey % 19 <> 0 AS listed FROM customer) AS r
      LEFT JOIN put_now AS p ON listed LEFT JOIN exposure AS e ON listed))""", r6=["strike", "put_price", "payoff", "budget"]),
    "k3_allocation_view": build("SELECT symbol, market_value, market_value / 100000e0 * 100 AS percentage FROM positions ORDER BY percentage DESC", r6=["market_value", "percentage"]),
}
