from oracle.ctes import build
import oracle.planning  # noqa: F401  (registers shared table expressions)

SQL = {
    "t1_attempt_limit": build("""
WITH RECURSIVE numbered AS (SELECT key, event_id, epoch_us(ts) AS at_us, success, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS n FROM access_events),
fold AS (
  SELECT key, event_id, at_us, n, at_us AS start, 1::BIGINT AS count, success AS cleared FROM numbered WHERE n = 1
  UNION ALL SELECT x.key, x.event_id, x.at_us, x.n,
    CASE WHEN f.cleared OR x.at_us >= f.start + 86400000000 THEN x.at_us ELSE f.start END,
    CASE WHEN f.cleared OR x.at_us >= f.start + 86400000000 THEN 1 ELSE f.count + 1 END,
    x.success AND CASE WHEN f.cleared OR x.at_us >= f.start + 86400000000 THEN 1 ELSE f.count + 1 END <= 5
  FROM fold AS f JOIN numbered AS x ON x.key = f.key AND x.n = f.n + 1)
SELECT key, event_id, at_us, count, count > 5 AS blocked FROM fold"""),
    "t2_latest_fresh": build("""
SELECT user_id, arg_max(value, ts) AS value, max(epoch_us(ts) // 1000000) AS seen_at FROM events
WHERE event_type <> 'view' AND epoch_us(ts) // 1000000 > 1706572800 - 43200 AND epoch_us(ts) // 1000000 <= 1706572800 GROUP BY 1""", r6=["value"]),
    "t3_order_resolution": build("SELECT order_id, status, filled_qty, resolved, poll AS polls FROM resolved_orders", r6=["filled_qty"]),
    "t4_fill_log": build("""
SELECT epoch_us(ts) AS ts_us, symbol AS ticker, upper(side) AS action, filled_qty AS quantity, 50e0 + order_id::BIGINT % 60 AS execution_price,
  NULL::DOUBLE AS wacc, NULL::DOUBLE AS var_95 FROM order_events WHERE filled_qty > 0
UNION ALL SELECT epoch_us(ts), 'PORTFOLIO', 'RISK_SNAPSHOT', 0e0, 0e0, NULL, 0.01e0 * (1 + user_id % 5) FROM events WHERE event_type = 'signup'""",
        r6=["quantity", "execution_price", "var_95"]),
}
# streams give what their batch twins give
SQL |= {f"{name}_stream": SQL[name] for name in ("t1_attempt_limit", "t2_latest_fresh", "t3_order_resolution")}
