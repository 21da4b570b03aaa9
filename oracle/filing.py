from oracle.ctes import build, cte

cte("extracted", """
SELECT l.ticker, l.latest_end, max(f.val) FILTER (field = 'revenue') AS revenue, max(f.val) FILTER (field = 'pretax') AS pretax,
  max(f.val) FILTER (field = 'tax') AS tax, max(f.val) FILTER (field = 'interest') AS interest, max(f.accn) FILTER (field = 'revenue') AS revenue_accn,
  max(c.val) AS cash, max(d.total_debt) AS total_debt, max(d.method) AS method, max(d.component_tags) AS component_tags,
  max(h.n) AS history_years, max(h.first_year) AS first_year
FROM latest_fy AS l JOIN fields AS f ON f.ticker = l.ticker AND f."end" = l.latest_end
LEFT JOIN inst AS c ON c.ticker = l.ticker AND c."end" = l.latest_end AND c.tag = 'CashAndCashEquivalentsAtCarryingValue'
LEFT JOIN debt_roll AS d ON d.ticker = l.ticker
LEFT JOIN (SELECT ticker, count(*) AS n, min("end") AS first_year FROM hist5 GROUP BY 1) AS h ON h.ticker = l.ticker GROUP BY 1, 2
""")

cte("planted", """
SELECT ticker, cik, tag, copy, form, start, "end", val, accn, filed FROM xbrl_rows
UNION ALL SELECT ticker, cik, 'InterestPaidNet', copy, form, start, "end", val * 0.9e0, accn, filed FROM xbrl_rows
  WHERE k % 3 = 0 AND tag IN ('InterestExpense', 'InterestExpenseNonoperating')
UNION ALL SELECT ticker, cik, 'DebtCurrent', copy, form, start, "end", val * 1.5e0, accn, filed FROM xbrl_rows WHERE k % 5 IN (1, 2) AND tag = 'LongTermDebtCurrent'
""")
cte("planted_interest", """
SELECT * FROM (SELECT f.ticker, f."end", f.val, method, row_number() OVER (PARTITION BY f.ticker, f."end" ORDER BY prio, filed, copy) AS rn
  FROM planted AS f JOIN companies AS c ON c.ticker = f.ticker JOIN (VALUES ('InterestExpense', 1, 'reported', false),
    ('InterestExpenseNonoperating', 2, 'reported', false), ('InterestPaidNet', 1, 'proxy_cash_paid_interest', true)) AS p(tag, prio, method, own)
  ON p.tag = f.tag AND p.own = (c.universe_pos % 6 = 0) WHERE form = '10-K' AND "end" - start BETWEEN 330 AND 400) WHERE rn = 1
""")
cte("planted_debt", """
SELECT p.*, prio, latest_end, CASE WHEN p.tag IN ('LongTermDebtCurrent', 'ShortTermBorrowings')
    THEN max(CASE WHEN p.tag = 'DebtCurrent' THEN p.tag END) OVER (PARTITION BY p.ticker) END AS covered_by,
  max(CASE WHEN p.tag = 'DebtLongtermAndShorttermCombinedAmount' THEN val END) OVER (PARTITION BY p.ticker) AS combined
FROM (SELECT *, row_number() OVER (PARTITION BY ticker, tag, "end" ORDER BY copy) AS rn FROM planted WHERE form = '10-K' AND start IS NULL) AS p
JOIN latest_fy AS l ON l.ticker = p.ticker AND l.latest_end = p."end" JOIN companies AS c ON c.ticker = p.ticker
JOIN (VALUES ('LongTermDebtNoncurrent', 0), ('LongTermDebtCurrent', 1), ('ShortTermBorrowings', 2), ('DebtCurrent', 3),
  ('DebtLongtermAndShorttermCombinedAmount', 4)) AS t(tag, prio) ON t.tag = p.tag
WHERE rn = 1 AND (c.universe_pos % 10 <> 1 OR prio IN (0, 1, 4))
""")


def fact(field: str, provenance: str) -> str:
    url = "'https://www.sec.gov/Archives/edgar/data/' || cik || '/' || replace(accn, '-', '') || '/' || accn || '-index.htm'"
    return f"""x.ticker, {field} AS field, x."end"::VARCHAR AS period, x.val AS raw_value, 'USD' AS units, x.tag AS source_field,
  x.accn AS accession, {url} AS source_url, x.filed::VARCHAR AS filed, '{provenance}' AS provenance"""


cte("manifest", f"""
SELECT {fact("CASE x.field WHEN 'revenue' THEN 'Revenue' ELSE 'EBIT/Operating Income' END", "reported")}
FROM fields AS x JOIN hist5 AS h ON h.ticker = x.ticker AND h."end" = x."end" WHERE x.field IN ('revenue', 'ebit')
UNION ALL SELECT {fact("CASE x.field WHEN 'pretax' THEN 'Pretax Income (latest)' WHEN 'tax' THEN 'Tax Provision (latest)' ELSE 'Interest Expense (latest)' END", "reported")}
FROM fields AS x JOIN latest_fy AS l ON l.ticker = x.ticker AND l.latest_end = x."end" WHERE x.field IN ('pretax', 'tax', 'interest')
UNION ALL SELECT {fact("'Cash & Equivalents (latest)'", "reported")}
FROM inst AS x JOIN latest_fy AS l ON l.ticker = x.ticker AND l.latest_end = x."end" WHERE x.tag = 'CashAndCashEquivalentsAtCarryingValue'
UNION ALL SELECT {fact("'Total Debt component: ' || x.tag", "reported (component)")}
FROM inst AS x JOIN latest_fy AS l ON l.ticker = x.ticker AND l.latest_end = x."end" WHERE x.tag IN ('LongTermDebtNoncurrent', 'LongTermDebtCurrent')
UNION ALL SELECT ticker, CASE WHEN method = 'summed' THEN 'Total Debt (latest, derived)' ELSE 'Total Debt (latest, reported)' END, latest_end::VARCHAR, total_debt, 'USD',
  CASE WHEN method = 'summed' THEN component_tags ELSE 'reported' END, accessions, CASE WHEN method = 'summed' THEN source_urls ELSE 'combined' END,
  CASE WHEN method = 'summed' THEN filed_dates ELSE 'combined' END, CASE WHEN method = 'summed' THEN 'derived (sum of components above)' ELSE 'reported' END FROM debt_roll
UNION ALL SELECT ticker, f, '2001-06-30T00:00:00Z', v, u, 'quote feed ' || f, NULL, 'https://quotes.example.org/' || ticker, '2001-06-30T00:00:00Z', 'reported (market)'
FROM (SELECT ticker, 'Current Price' AS f, alt_price AS v, 'USD/share' AS u FROM companies UNION ALL SELECT ticker, 'Shares Outstanding', shares_outstanding, 'shares' FROM companies
  UNION ALL SELECT ticker, 'Beta', beta, 'unitless' FROM companies UNION ALL SELECT ticker, 'Sector (GICS)', NULL, 'category' FROM companies)
""")
cte("damaged", """
SELECT * FROM (SELECT * REPLACE (
    CASE WHEN g = 3 AND field = 'Total Debt (latest, derived)' THEN raw_value * 2 ELSE raw_value END AS raw_value,
    CASE WHEN g = 4 AND field LIKE 'Total Debt component: %' THEN '' WHEN g = 5 AND field = 'Total Debt (latest, derived)' THEN accession || '; ' || accession
      WHEN g = 6 AND field = 'Revenue' THEN NULL ELSE accession END AS accession,
    CASE WHEN g = 7 AND field = 'Beta' THEN '' ELSE period END AS period,
    CASE WHEN g = 8 AND field = 'Total Debt (latest, derived)' THEN 'reported' ELSE provenance END AS provenance)
  FROM (SELECT *, substr(ticker, 2)::INTEGER % 12 AS g FROM manifest) WHERE NOT (g = 1 AND field = 'Tax Provision (latest)')),
  (SELECT unnest([1, 2]) AS copy) WHERE copy = 1 OR (g = 2 AND field = 'Beta')
""")
LATEST = "('Pretax Income (latest)'), ('Tax Provision (latest)'), ('Interest Expense (latest)'), ('Cash & Equivalents (latest)'), ('Current Price'), ('Shares Outstanding'), ('Beta'), ('Sector (GICS)')"
MARKET = "('Current Price', 'Shares Outstanding', 'Beta', 'Sector (GICS)')"

SQL = {
    "l8_fact_filter": build('SELECT ticker, tag, start, "end", val, accn, filed FROM annual', r2=["val"]),
    "w13_first_filed": build('SELECT ticker, tag, "end", val, accn, filed FROM firsts', r2=["val"]),
    "u3_tag_merge": build("SELECT ticker, \"end\", tag, val, accn FROM fields WHERE field = 'revenue'", r2=["val"]),
    "j6_tag_intersection": build("SELECT * FROM latest_fy"),
    "w17_last_five_years": build('SELECT ticker, "end", revenue, ebit, revenue_tag, years_back::INTEGER AS years_back FROM hist5', r2=["revenue", "ebit"]),
    "a16_debt_rollup": build("SELECT * FROM debt_roll", r2=["total_debt"]),
    "l9_company_extraction": build("SELECT * FROM extracted", r2=["revenue", "pretax", "tax", "interest", "cash", "total_debt"]),
    "l9_own_tag_lists": build("""
SELECT l.ticker, l.latest_end, i.val AS interest, i.method AS interest_method, coalesce(d.combined, d.total) AS total_debt,
  CASE WHEN d.ticker IS NULL THEN NULL WHEN d.combined IS NULL THEN 'summed' ELSE 'reported' END AS method,
  CASE WHEN d.ticker IS NULL THEN NULL WHEN d.combined IS NULL THEN d.tags ELSE '' END AS component_tags
FROM latest_fy AS l LEFT JOIN planted_interest AS i ON i.ticker = l.ticker AND i."end" = l.latest_end
LEFT JOIN (SELECT ticker, max(combined) AS combined, sum(val ORDER BY prio) FILTER (covered_by IS NULL) AS total,
  string_agg(tag, '; ' ORDER BY prio) FILTER (covered_by IS NULL) AS tags FROM planted_debt GROUP BY 1) AS d ON d.ticker = l.ticker""", r2=["interest", "total_debt"]),
    "a16_debt_components": build("""
SELECT ticker, latest_end, tag, val, accn, filed, covered_by,
  'https://www.sec.gov/Archives/edgar/data/' || cik || '/' || replace(accn, '-', '') || '/' || accn || '-index.htm' AS source_url,
  CASE WHEN combined IS NOT NULL THEN 'combined' WHEN covered_by IS NOT NULL THEN 'part' ELSE 'added' END AS use
FROM planted_debt WHERE prio < 4""", r2=["val"]),
    "x24_filing_urls": build("""
SELECT DISTINCT accn, 'https://www.sec.gov/Archives/edgar/data/' || cik || '/' || replace(accn, '-', '') || '/' || accn || '-index.htm' AS url FROM xbrl_rows"""),
    "u4_provenance_rows": build("SELECT * FROM manifest", r2=["raw_value"]),
    "l10_manifest_completeness": build(f"""
SELECT ticker, field, 'accession' AS column_name FROM damaged WHERE field NOT IN {MARKET} AND coalesce(accession, '') = ''
UNION ALL SELECT ticker, field, 'period' FROM damaged WHERE field IN {MARKET} AND coalesce(period, '') = ''
UNION ALL SELECT ticker, field, 'provenance' FROM damaged WHERE field = 'Total Debt (latest, derived)' AND provenance NOT LIKE '%derived%'"""),
    "l11_manifest_structure": build(f"""
SELECT ticker, 'count: ' || field AS problem FROM (SELECT e.ticker, f.field, count(d.field) AS c FROM extracted AS e CROSS JOIN (VALUES {LATEST}) AS f(field)
  LEFT JOIN damaged AS d ON d.ticker = e.ticker AND d.field = f.field GROUP BY 1, 2) WHERE c <> 1
UNION ALL SELECT t.ticker, 'component_sum' FROM damaged AS t JOIN (SELECT ticker, sum(raw_value) AS s FROM damaged WHERE field LIKE 'Total Debt component: %' GROUP BY 1) AS c
  ON c.ticker = t.ticker WHERE t.field = 'Total Debt (latest, derived)' AND abs(c.s - t.raw_value) > 1e-9 * abs(t.raw_value)
UNION ALL SELECT ticker, 'foreign_accession' FROM damaged AS t WHERE field = 'Total Debt (latest, derived)' AND EXISTS (SELECT 1 FROM damaged AS c
  WHERE c.ticker = t.ticker AND c.field LIKE 'Total Debt component: %' AND c.accession <> t.accession AND c.accession NOT IN (SELECT trim(unnest(string_split(t.accession, ';')))))
UNION ALL SELECT ticker, 'repeated_accession' FROM damaged WHERE field = 'Total Debt (latest, derived)' AND len(string_split(accession, ';')) <> len(list_distinct(list_transform(string_split(accession, ';'), lambda p: trim(p))))"""),
    "u2_manifest_differences": build(f"""
SELECT ticker, field, 'missing' AS side FROM (SELECT ticker, field FROM latest_fy, (VALUES {LATEST}) AS f(field)
  EXCEPT ALL SELECT ticker, field FROM damaged WHERE field IN (SELECT field FROM (VALUES {LATEST}) AS f(field)))
UNION ALL SELECT ticker, field, 'extra' FROM (SELECT ticker, field FROM damaged WHERE field IN (SELECT field FROM (VALUES {LATEST}) AS f(field))
  EXCEPT ALL SELECT ticker, field FROM latest_fy, (VALUES {LATEST}) AS f(field))"""),
    "l12_snapshot_schema": build("""
SELECT file_ticker, CASE WHEN malformed THEN 'malformed' WHEN k % 24 = 0 THEN 'entity_name_empty' WHEN k % 27 = 0 THEN 'history_empty'
  WHEN k % 11 = 0 THEN 'cash_and_equivalents_usd_invalid' WHEN alt_price IS NULL THEN 'current_price_usd_per_share_invalid'
  WHEN beta IS NULL THEN 'beta_levered_equity_invalid' WHEN sector IS NULL THEN 'sector_gics_empty' ELSE 'ok' END AS problem FROM snap"""),
    "l13_adapter_check": build("""
SELECT ticker, period_end, line_item, value + d AS value, side FROM (SELECT * FROM snap_statements WHERE line_item IN ('Total Revenue', 'EBIT') AND ticker LIKE '%5'),
  (VALUES (0e0, 'lost'), (1e0, 'altered')) AS v(d, side)""", r2=["value"]),
}
