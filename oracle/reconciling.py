from oracle.ctes import build, cte

# Kind and tolerance of each compared metric, in order.
TOLERANCES = {
    "revenue_cagr": ("rate", 0.0001), "operating_margin": ("rate", 0.0001), "wacc": ("rate", 0.0005),
    "fcf_year_1": ("money", 0.001), "fcf_year_2": ("money", 0.001), "fcf_year_3": ("money", 0.001),
    "fcf_year_4": ("money", 0.001), "fcf_year_5": ("money", 0.001), "terminal_value": ("money", 0.002),
    "pv_explicit_fcf": ("money", 0.002), "pv_terminal_value": ("money", 0.002), "enterprise_value": ("money", 0.002),
    "equity_value": ("money", 0.002), "intrinsic_value_per_share": ("money", 0.005),
}
TOTALS = ("terminal_value", "enterprise_value", "equity_value", "intrinsic_value")
FLOWS = tuple(f"fcf_{y}" for y in range(1, 6))
OUTPUTS = {1: TOTALS, 2: TOTALS, 3: FLOWS + TOTALS, 4: FLOWS + TOTALS, 5: ("intrinsic_value",)}


def valued(source: str, g: str, m: str, w: str, tg: str, prefix: str = "") -> str:
    """Adds the flows and values at growth g, margin m, rate w and terminal growth tg.

    Revenue is a list by year, present values discount year by year from the last one back.
    """
    def back(values: str, start: str) -> str:
        return f"list_reduce(list_reverse({values}), lambda later, now: now + later / (1 + {w}), {start})"

    flows = ", ".join(f"{prefix}flows[{y}] AS {prefix}fcf_{y}" for y in range(1, 6))
    return f"""
SELECT *, {prefix}enterprise_value - debt_used + cash_used AS {prefix}equity_value,
  ({prefix}enterprise_value - debt_used + cash_used) / shares AS {prefix}intrinsic_value FROM (
  SELECT *, {prefix}pv_explicit_fcf + {prefix}pv_terminal_value AS {prefix}enterprise_value FROM (
    SELECT *, {prefix}terminal_value / (1 + {w}) / (1 + {w}) / (1 + {w}) / (1 + {w}) / (1 + {w}) AS {prefix}pv_terminal_value FROM (
      SELECT *, {flows}, {back(prefix + "flows", "0e0")} / (1 + {w}) AS {prefix}pv_explicit_fcf,
        CASE WHEN {w} > {tg} THEN ({prefix}flows[5] + {prefix}flows[5] * {tg}) / ({w} - {tg}) END AS {prefix}terminal_value FROM (
        SELECT *, [{prefix}sales[y + 1] * {m} - {prefix}sales[y + 1] * {m} * tax_used + 0.03e0 * {prefix}sales[y + 1] - 0.04e0 * {prefix}sales[y + 1]
            - 0.01e0 * ({prefix}sales[y + 1] - {prefix}sales[y]) for y in [1, 2, 3, 4, 5]] AS {prefix}flows FROM (
          SELECT *, [rev_last * pow(1 + {g}, y) for y in [0, 1, 2, 3, 4, 5]] AS {prefix}sales FROM {source})))))"""


cte("second_source", """
SELECT h.*, m.pretax, m.tax_provision, m.interest, m.price, m.shares, m.risk_free, coalesce(m.total_debt, 0e0) AS debt_used,
  coalesce(m.cash, 0e0) AS cash_used, coalesce(m.beta, 1e0) AS beta_used, m.pretax <> 0 AND m.tax_provision IS NOT NULL AS taxed,
  m.total_debt <> 0 AND m.interest IS NOT NULL AS indebted
FROM (SELECT ticker, arg_min(revenue, period_end) AS rev_first, arg_max(revenue, period_end) AS rev_last,
    (max(period_end) - min(period_end)) / 365.25e0 AS days, count(*) - 1e0 AS periods, avg(ebit / revenue) FILTER (revenue > 0) AS avg_margin
  FROM inc WHERE revenue IS NOT NULL GROUP BY ticker) AS h
JOIN market_rows AS m ON m.ticker = h.ticker AND m.as_of = DATE '2001-06-30'
""")
for _name, _rule in (("second_days", "days"), ("second_periods", "periods")):
    cte(f"{_name}_rates", f"""
SELECT *, least(raw_cagr, 0.25e0) AS capped_cagr, greatest(0.05e0, least(0.2e0, raw_wacc)) + 0 * raw_wacc AS wacc FROM (
  SELECT *, (price * shares * (risk_free + 0.055e0 * beta_used) + debt_used * debt_cost_used * (1 - tax_used))
      / CASE WHEN price > 0 AND shares > 0 THEN price * shares + debt_used END AS raw_wacc FROM (
    SELECT *, CASE WHEN rev_first > 0 AND rev_last > 0 AND {_rule} > 0 THEN exp(ln(rev_last / rev_first) / {_rule}) - 1 END AS raw_cagr,
      CASE WHEN tax_method = 'derived' THEN tax_provision / pretax ELSE 0.21e0 END AS tax_used,
      CASE WHEN debt_method = 'derived' THEN abs(interest / debt_used) ELSE 0.05e0 END AS debt_cost_used FROM (
      SELECT *, CASE WHEN taxed IS NOT TRUE THEN 'fallback:missing_or_zero_pretax' WHEN tax_provision / pretax >= 1 OR tax_provision / pretax < 0
          THEN 'fallback:out_of_range' ELSE 'derived' END AS tax_method,
        CASE WHEN indebted THEN 'derived' ELSE 'fallback:missing_or_zero_debt' END AS debt_method FROM second_source)))
""")
    cte(_name, valued(f"{_name}_rates", "capped_cagr", "avg_margin", "wacc", "0.025e0")
        + (" WHERE wacc IS NOT NULL" if _rule == "periods" else ""))
cte("made", f"""
SELECT v.*, {", ".join(f"f.f{y} AS fcf_{y}" for y in range(1, 6))} FROM dcf AS v JOIN (
  SELECT ticker, as_of, {", ".join(f"max(fcf) FILTER (y = {y}) AS f{y}" for y in range(1, 6))} FROM flows GROUP BY 1, 2) AS f
  ON f.ticker = v.ticker AND f.as_of = v.as_of WHERE v.as_of = DATE '2001-06-30' AND price > 0 AND wacc > 0.025e0
""")
COLUMNS = {
    "revenue_cagr": ("growth", "capped_cagr"), "operating_margin": ("margin", "avg_margin"), "wacc": ("wacc", "wacc"),
    **{f"fcf_year_{y}": (f"fcf_{y}", f"fcf_{y}") for y in range(1, 6)},
    **{m: (m, m) for m in ("terminal_value", "pv_explicit_fcf", "pv_terminal_value", "enterprise_value", "equity_value")},
    "intrinsic_value_per_share": ("intrinsic_value", "intrinsic_value"),
}


def melted(source: str, side: int, tweak=None) -> str:
    parts = []
    for i, m in enumerate(TOLERANCES):
        value = (tweak or {}).get(m, COLUMNS[m][side])
        parts.append(f"SELECT ticker, '{m}' AS metric, {i} AS metric_pos, {value} AS value FROM {source}")
    return " UNION ALL ".join(parts)


TOLS = ", ".join(f"('{m}', '{k}', {t!r}::DOUBLE)" for m, (k, t) in TOLERANCES.items())


def compared(left: str, right: str) -> str:
    return f"""
SELECT ticker, j.metric, metric_pos, produced, expected, CASE WHEN kind = 'rate' THEN 'percentage_points' WHEN expected = 0 THEN 'absolute' ELSE 'relative' END AS difference_kind,
  CASE WHEN kind = 'rate' THEN tol * 100 WHEN expected = 0 THEN 1e-6 ELSE tol END AS tolerance,
  coalesce(CASE WHEN kind = 'rate' THEN abs(produced - expected) <= tol WHEN expected = 0 THEN abs(produced) <= 1e-6
    ELSE abs(produced - expected) / abs(expected) <= tol END, false) AS passed
FROM (SELECT coalesce(a.ticker, b.ticker) AS ticker, coalesce(a.metric, b.metric) AS metric, coalesce(a.metric_pos, b.metric_pos) AS metric_pos,
    a.value AS produced, b.value AS expected FROM ({left}) AS a FULL JOIN ({right}) AS b ON a.ticker = b.ticker AND a.metric = b.metric) AS j
JOIN (VALUES {TOLS}) AS k(metric, kind, tol) ON k.metric = j.metric"""


cte("made_melted", melted("made", 0))
cte("second_melted", melted("second_periods", 1))
cte("base_compared", compared("SELECT * FROM made_melted", "SELECT * FROM second_melted"))
cte("shifted_compared", compared(
    melted("made", 0, {"wacc": "wacc + CASE WHEN ticker LIKE '%3' THEN 0.01e0 ELSE 0e0 END"}), "SELECT * FROM second_melted"))
# The grids of the five tables; null keeps the base value.
cte("grid", """
SELECT 1 AS table_no, i AS pos, [0.05e0, 0.075e0, 0.1e0, 0.125e0, 0.15e0, 0.175e0, 0.2e0][i + 1] AS s_wacc,
  NULL::DOUBLE AS s_terminal, NULL::DOUBLE AS s_growth, NULL::DOUBLE AS s_margin FROM range(7) AS r(i)
UNION ALL SELECT 2, i, NULL, [0e0, 0.01e0, 0.02e0, 0.025e0, 0.03e0, 0.04e0, 0.05e0][i + 1], NULL, NULL FROM range(7) AS r(i)
UNION ALL SELECT 3, i, NULL, NULL, [-0.1e0, -0.05e0, 0e0, 0.05e0, 0.1e0, 0.2e0, 0.3e0, 0.4e0][i + 1], NULL FROM range(8) AS r(i)
UNION ALL SELECT 4, i, NULL, NULL, NULL, [0e0, 0.1e0, 0.2e0, 0.3e0, 0.4e0, 0.5e0, 0.6e0][i + 1] FROM range(7) AS r(i)
UNION ALL SELECT 5, i, [0.05e0, 0.08e0, 0.11e0, 0.14e0, 0.17e0, 0.2e0][i // 6 + 1], [0e0, 0.01e0, 0.02e0, 0.03e0, 0.04e0, 0.05e0][i % 6 + 1],
  NULL, NULL FROM range(36) AS r(i)
""")


def cells(source: str) -> str:
    return valued(f"""(SELECT *, coalesce(s_wacc, wacc) AS x_wacc, coalesce(s_terminal, 0.025e0) AS x_terminal,
            coalesce(s_growth, capped_cagr) AS x_growth, coalesce(s_margin, avg_margin) AS x_margin FROM {source}, grid)""",
        "x_growth", "x_margin", "x_wacc", "x_terminal", "cell_")


cte("second_cells", cells("second_periods"))
# The base case renamed to the second formulation's column names.
cte("made_base", """
SELECT ticker, revenue AS rev_last, growth AS capped_cagr, margin AS avg_margin, tax_rate AS tax_used, wacc,
  coalesce(total_debt, 0e0) AS debt_used, coalesce(cash, 0e0) AS cash_used, shares FROM made
""")
cte("made_cells", cells("made_base"))
NAMES = sorted({o for outs in OUTPUTS.values() for o in outs})


def melted_cells(source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT ticker, table_no, pos, '{o}' AS output, cell_{o} AS value FROM {source} WHERE table_no IN ({', '.join(str(t) for t, outs in OUTPUTS.items() if o in outs)})"
        for o in NAMES)


cte("cells_compared", f"""
SELECT a.ticker, a.table_no::INTEGER AS table_no, a.pos::INTEGER AS pos, a.output,
  CASE WHEN a.value IS NULL OR b.value IS NULL THEN 'missing' WHEN b.value = 0 THEN 'absolute' ELSE 'relative' END AS kind,
  CASE WHEN a.value IS NULL OR b.value IS NULL THEN a.value IS NULL AND b.value IS NULL WHEN b.value = 0 THEN abs(a.value) <= 1e-6
    ELSE abs(a.value - b.value) / abs(b.value) <= CASE WHEN a.output LIKE 'fcf%' THEN 0.001e0 WHEN a.output = 'intrinsic_value' THEN 0.005e0 ELSE 0.002e0 END END AS passed
FROM ({melted_cells("made_cells")}) AS a JOIN ({melted_cells("second_cells")}) AS b
  ON a.ticker = b.ticker AND a.table_no = b.table_no AND a.pos = b.pos AND a.output = b.output
""")
cte("injected", """
SELECT *, final_fcf * 1.025e0 / wacc AS bad_tv, final_fcf * 1.025e0 / wacc / pow(1 + wacc, 5) AS bad_pv FROM made
""")
MONEY = ["terminal_value", "pv_explicit_fcf", "pv_terminal_value", "enterprise_value", "equity_value"]
DIVERGENCE = """
SELECT ticker, arg_min(metric, metric_pos) FILTER (NOT passed) AS first_divergence, count(*) FILTER (NOT passed) AS failures FROM {0} GROUP BY 1"""

SQL = {
    "x23_second_dcf": build(f"""
SELECT ticker, raw_cagr, capped_cagr, avg_margin, tax_used, tax_method, debt_cost_used, debt_method, raw_wacc, wacc, {', '.join(MONEY)}, intrinsic_value FROM second_days""",
        r2=MONEY, r6=["raw_cagr", "capped_cagr", "avg_margin", "tax_used", "debt_cost_used", "raw_wacc", "wacc", "intrinsic_value"]),
    "j12_full_outer_compare": build("SELECT ticker, metric, produced, expected, passed FROM (" + compared(
        "SELECT * FROM made_melted WHERE ticker NOT LIKE '%5'", "SELECT * FROM second_melted WHERE ticker NOT LIKE '%7'") + ")",
        r2=["produced", "expected"]),
    "l3_tolerance_compare": build("SELECT ticker, metric, difference_kind, tolerance, passed FROM base_compared", r6=["tolerance"]),
    "l5_base_reconciliation": build(DIVERGENCE.format("base_compared")),
    "w15_first_divergence": build(DIVERGENCE.format("shifted_compared")),
    "a13_directional_bias": build("""
SELECT metric, above, below, above + below >= 2 AND (above = 0 OR below = 0) AS biased FROM (
  SELECT metric, count(*) FILTER (d > 0) AS above, count(*) FILTER (d < 0) AS below FROM (
    SELECT metric, CASE WHEN abs(produced - expected) <= 1e-9 * abs(expected) THEN 0 ELSE produced - expected END AS d FROM base_compared) GROUP BY 1)"""),
    "l4_cell_compare": build("SELECT * FROM cells_compared"),
    "a15_coverage": build("""
SELECT ticker, table_no, count(DISTINCT pos) AS scenarios, count(DISTINCT output) AS outputs, count(*) AS scalars, bool_and(passed) AS all_passed
FROM cells_compared GROUP BY 1, 2"""),
    "w14_monotonic": build("""
SELECT ticker, table_no::INTEGER AS table_no, bool_and(coalesce(CASE WHEN table_no = 1 THEN step <= 1e-9 ELSE step >= -1e-9 END, true)) AS monotonic
FROM (SELECT ticker, table_no, cell_intrinsic_value - lag(cell_intrinsic_value) OVER (PARTITION BY ticker, table_no ORDER BY pos) AS step
  FROM made_cells WHERE table_no < 5 AND cell_intrinsic_value IS NOT NULL) GROUP BY 1, 2"""),
    "l6_sensitivity_reconciliation": build("""
SELECT ticker, count(*) AS scalars, count(*) FILTER (NOT passed) AS failures, bool_and(passed) AS all_passed FROM cells_compared GROUP BY 1"""),
    "a14_verdict": build("SELECT ticker FROM shifted_compared GROUP BY 1 HAVING NOT bool_and(passed)"),
    "l16_reconciliation_run": build("""
SELECT b.p AS base_pass, b.f AS base_failing, c.p AS sensitivity_pass, c.f AS sensitivity_failing, b.p AND c.p AS overall_pass
FROM (SELECT bool_and(ok) AS p, count(*) FILTER (NOT ok) AS f FROM (SELECT bool_and(passed) AS ok FROM base_compared GROUP BY ticker)) AS b,
  (SELECT bool_and(ok) AS p, count(*) FILTER (NOT ok) AS f FROM (SELECT bool_and(passed) AS ok FROM cells_compared GROUP BY ticker)) AS c"""),
    "l7_error_injection": build("""
SELECT ticker, u.metric, u.d AS difference, u.t AS tolerance, u.d > u.t AS detected FROM (
  SELECT ticker, unnest([{'metric': 'terminal_value', 'd': abs(terminal_value - bad_tv) / abs(terminal_value), 't': 0.002e0},
    {'metric': 'pv_terminal_value', 'd': abs(pv_terminal_value - bad_pv) / abs(pv_terminal_value), 't': 0.002e0},
    {'metric': 'enterprise_value', 'd': abs(pv_terminal_value - bad_pv) / abs(enterprise_value), 't': 0.002e0},
    {'metric': 'equity_value', 'd': abs(pv_terminal_value - bad_pv) / abs(equity_value), 't': 0.002e0},
    {'metric': 'intrinsic_value', 'd': abs(pv_terminal_value - bad_pv) / abs(equity_value), 't': 0.005e0}]) AS u FROM injected)""", r6=["difference", "tolerance"]),
    "l15_fiscal_calendar": build("""
SELECT ticker, count(*) AS periods, (max(p) - min(p)) / 365.25e0 AS years_actual, count(*) - 1e0 AS years_naive,
  abs((max(p) - min(p)) / 365.25e0 - (count(*) - 1)) > 0.05e0 AS irregular
FROM (SELECT ticker, CASE WHEN substr(ticker, 2)::INTEGER % 6 = 0 AND period_end = DATE '2000-12-31' THEN DATE '2001-03-31' ELSE period_end END AS p FROM inc)
GROUP BY 1""", r6=["years_actual", "years_naive"]),
}
