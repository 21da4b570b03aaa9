"""Table schemas shared by sources, operators and tests (DDL strings)."""

COMPANIES = (
    "ticker string, sector string, industry string, beta double, last_price double, "
    "alt_price double, shares_outstanding double, universe_pos int"
)
STATEMENTS = "ticker string, statement string, line_item string, period_end date, value double"
PRICES = "ticker string, date date, close double"
SPLITS = "ticker string, date date, ratio double"
SHARES = "ticker string, date date, shares double"
HOLDINGS = "portfolio_id string, ticker string, weight double"
POSITIONS = (
    "symbol string, asset_class string, qty double, market_value double, "
    "current_price double, avg_entry_price double"
)
OPTION_CHAIN = (
    "symbol string, underlying string, expiration_date date, strike_price double, "
    "tradable boolean, chain_pos int"
)
ORDER_EVENTS = (
    "order_id string, symbol string, side string, status string, filled_qty double, "
    "filled_avg_price double, ts timestamp_ntz"
)
TRADE_LOGS = (
    "ts timestamp_ntz, ticker string, action string, quantity double, execution_price double, "
    "wacc double, beta double, conviction_score double, altman_z_score double, "
    "var_95 double, cvar_95 double"
)
BACKTEST_CURVE = "date date, strategy_value double, benchmark_value double"
XBRL_FACTS = (
    "map<string, struct<units: map<string, array<struct<"
    "form: string, start: date, end: date, val: double, accn: string, filed: date>>>>>"
)
NEWS_ITEMS = (
    "array<struct<content: struct<title: string, provider: struct<displayName: string>, "
    "canonicalUrl: struct<url: string>, clickThroughUrl: struct<url: string>, pubDate: string>, "
    "title: string, provider: struct<displayName: string>, canonicalUrl: struct<url: string>, "
    "clickThroughUrl: struct<url: string>, pubDate: string, "
    "publisher: string, link: string, providerPublishTime: bigint>>"
)
SNAPSHOT = (
    "ticker string, entity_name string, cik string, latest_complete_fiscal_year_end string, "
    "historical_annual_data array<struct<fiscal_period_end: string, revenue_raw_usd: double, "
    "ebit_raw_usd: double, revenue_xbrl_tag: string, revenue_accession: string, "
    "revenue_source_url: string, revenue_filed_date: string>>, "
    "latest_year_facts struct<pretax_income_usd: double, tax_provision_usd: double, "
    "interest_expense_usd: double, total_debt_usd: double, cash_and_equivalents_usd: double, "
    "pretax_income_accession: string>, "
    "market_data struct<current_price_usd_per_share: double, shares_outstanding: double, "
    "beta_levered_equity: double, sector_gics: string, retrieved_at_utc: string>"
)
