from oracle.ctes import build

TRADES = "(SELECT * FROM trade_logs WHERE action <> 'RISK_SNAPSHOT')"

SQL = {
    "k2_paged_trades": build(f"""
SELECT * FROM (SELECT event_id, ticker, action, quantity, count(*) OVER () AS total FROM {TRADES} ORDER BY ts DESC, event_id DESC LIMIT 75 OFFSET 50)""", r6=["quantity"]),
    "k2_page_fallback": build(f"SELECT event_id FROM {TRADES} ORDER BY ts DESC, event_id DESC LIMIT 50"),
    "k2_page_after_cursor": build(f"SELECT event_id, ticker, action, quantity FROM {TRADES} ORDER BY ts DESC, event_id DESC LIMIT 75 OFFSET 150", r6=["quantity"]),
    "w16_latest_trade": build(f"""
SELECT ticker, event_id, action, quantity, execution_price, conviction_score FROM (
  SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC, event_id DESC) AS rn FROM {TRADES}) WHERE rn = 1""",
        r6=["quantity", "execution_price", "conviction_score"]),
    "w16_latest_risk": build("""
SELECT CASE WHEN var_95 IS NULL OR cvar_95 IS NULL THEN 'unavailable' ELSE 'ok' END AS status, var_95, cvar_95, ts::DATE AS as_of
FROM trade_logs WHERE action = 'RISK_SNAPSHOT' ORDER BY ts DESC, event_id DESC LIMIT 1""", r6=["var_95", "cvar_95"]),
}
