"""Curves, metrics, lookup refusals, text helpers and data-quality checks."""

import hashlib
import hmac
import math
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark import schemas
from tidemark.functions import text
from tidemark.functions.numeric import is_finite, positive_whole
from tidemark.operators import backtest as bt, facts as fa, lookup, orders, reconcile as rc
from tidemark.sources import integrity, news, sinks, snapshots, statements as st


def d(s):
    return date.fromisoformat(s)


def curve(spark, points):
    return spark.createDataFrame(
        [("c", d(p), float(s), float(b)) for p, s, b in points],
        "id string, date date, strategy double, benchmark double")


def test_curve_starts_at_the_first_common_month(spark):
    months = ["2024-01-31", "2024-02-29", "2024-03-28", "2024-04-30"]
    cells = [("M", d(m), 100.0 * (i + 1)) for i, m in enumerate(months)]
    cells += [("A", d(m), 50.0 + i) for i, m in enumerate(months[1:])]
    cells += [("IDX", d(m), 10.0 + i) for i, m in enumerate(months)]
    prices = spark.createDataFrame(cells, schemas.PRICES)
    picks = spark.createDataFrame(
        [("M", d("2024-01-01")), ("A", d("2024-01-01")), ("GONE", d("2024-01-01"))],
        "ticker string, as_of date")
    got = bt.equity_curve(picks, prices, "IDX", ["2024-01-01"], "2024-12-31").orderBy("month").collect()
    assert [str(r.month) for r in got] == ["2024-02-01", "2024-03-01", "2024-04-01"]
    assert got[0].strategy == got[0].benchmark == 100_000.0
    assert math.isclose(got[2].strategy, 50_000 * (400 / 200) + 50_000 * (52 / 50))
    assert [r.ticker for r in bt.dropped_picks(picks, prices, "2024-12-31").collect()] == ["GONE"]


def test_metrics_against_direct_formulas(spark):
    pts = [("2024-01-01", 100, 100), ("2024-02-01", 120, 110), ("2024-03-01", 90, 105),
           ("2024-04-01", 135, 104)]
    r = bt.curve_metrics(curve(spark, pts), ("id",)).first()
    assert math.isclose(r.strategy_total, 35.0) and math.isclose(r.benchmark_total, 4.0)
    assert math.isclose(r.strategy_annual, (1.35 ** (365.25 / 91) - 1) * 100)
    assert math.isclose(r.max_drawdown, 25.0)
    assert math.isclose(r.win_rate, 200 / 3)
    steps = [math.log(b / a) for a, b in zip([100, 120, 90], [120, 90, 135])]
    mean = sum(steps) / 3
    sd = math.sqrt(sum((x - mean) ** 2 for x in steps) / 2)
    assert math.isclose(r.volatility, sd * math.sqrt(365.25 / (91 / 3)) * 100)
    assert math.isclose(r.sharpe, (r.strategy_annual / 100 - 0.045) / (r.volatility / 100))


def test_short_curves_give_zeros(spark):
    r = bt.curve_metrics(curve(spark, [("2024-01-01", 100, 100)]), ("id",)).first()
    assert r.points == 1 and r.alpha == r.sharpe == r.win_rate == r.volatility == 0.0


def test_win_rate_compares_by_position_after_dropping(spark):
    # the strategy loses its second step (base 0), so its third aligns with the second benchmark step
    pts = [("2024-01-01", 100, 100), ("2024-02-01", 0, 101), ("2024-03-01", 50, 151.5),
           ("2024-04-01", 100, 150)]
    r = bt.win_rate(curve(spark, pts), ("id",)).first()
    # strategy: -100%, +100%; benchmark: +1%, +50%, -1%
    assert math.isclose(r.win_rate, 50.0)


DOC = ('{"generated_at": %s, "universe_size": %s, "tickers_used": %s, "risk_free_rate": %s, '
       '"assumptions": {"terminal_growth_rate": 0.025}, "sector_medians": {"T": 1.2, "N": null}, '
       '"sector_sample_counts": {"T": %s}}')


def ask(spark, doc, sector="T", rf=0.045, tg=0.025, growth=None):
    df = spark.createDataFrame(
        [(doc, sector, rf, growth, None, tg)],
        "doc string, sector string, risk_free double, growth_request double, "
        "margin_request double, terminal_request double")
    r = lookup.lookup(lookup.parse_documents(df), "2024-01-03 00:00:00").first()
    assert (r.sector_median is None) != (r.unavailable_reason is None)
    return r.sector_median, r.unavailable_reason


def doc(stamp='"2024-01-02T00:00:00+00:00"', size=100, used=60, rf=0.045, n=3):
    return DOC % (stamp, size, used, rf, n)


@pytest.mark.parametrize("document, over, reason", [
    ("[1, 2]", {}, "malformed"), ('{"generated_at": ', {}, "malformed"),
    (doc("null"), {}, "not_generated"), (doc('"soon"'), {}, "bad_timestamp"),
    (doc('"2024-01-02T00:00:00"'), {}, "naive_timestamp"),
    (doc('"2023-12-31T23:59:59+00:00"'), {}, "stale"),
    (doc(size="null"), {}, "bad_universe_size"), (doc(used=-1), {}, "bad_tickers_used"),
    (doc(size=0), {}, "empty_universe"), (doc(used=49), {}, "low_coverage"),
    (doc(), dict(tg=0.03), "different_assumptions"), (doc(), dict(growth=0.1), "different_assumptions"),
    (doc(rf="null"), {}, "bad_cached_rate"), (doc(), dict(rf=float("nan")), "bad_requested_rate"),
    (doc(), dict(rf=0.0461), "rate_differs"), (doc(), dict(sector="X"), "no_sector"),
    (doc(), dict(sector="N"), "no_sector"), (doc(n=2), {}, "too_few_samples"),
])
def test_lookup_refusals(spark, document, over, reason):
    assert ask(spark, document, **over) == (None, reason)


def test_lookup_answers_within_tolerance(spark):
    assert ask(spark, doc(used=50), rf=0.0454)[0] == 1.2
    assert ask(spark, doc('"2024-01-01T00:00:00Z"'))[0] == 1.2  # exactly 48 hours old


def test_paging_falls_back(spark):
    df = spark.range(500)
    assert lookup.page(df).count() == 50
    assert lookup.page(df, 1000).count() == 200
    assert lookup.page(df, -1, "x").count() == 50
    assert lookup.page(df, 10, 495).count() == 5
    assert lookup.page(df, "75", "450").count() == 50 and lookup.page(df, "75").count() == 75
    assert lookup.page(df, float("nan"), float("inf")).count() == 50
    assert lookup.allocation(spark.createDataFrame([("a", 1.0)], "symbol string, market_value double"),
                             0).count() == 0


def test_number_predicates(spark):
    df = spark.createDataFrame(
        [(0.05,), (float("nan"),), (float("inf"),), (-float("inf"),), (None,), (3.0,), (0.0,), (2.5,)],
        "x double")
    got = df.select(is_finite("x").alias("f"), positive_whole("x").alias("w")).collect()
    assert [r.f for r in got] == [True, False, False, False, False, True, True, True]
    assert [r.w for r in got] == [None, None, None, None, None, 3, None, None]


def test_keyed_digest_equals_the_standard_one(spark):
    for key in (b"k", b"x" * 64, b"y" * 100):
        df = spark.createDataFrame([("  Äb1 ",)], "s string")
        got = df.select(text.pseudonym("s", key)).first()[0]
        assert got == hmac.new(key, "äb1".encode(), hashlib.sha256).hexdigest()


@pytest.mark.parametrize("link, safe", [
    ("https://a.example", True), ("HTTP://A", True), ("javascript:alert(1)", False),
    ("data:text/html,x", False), ("", False), (None, False), ("/relative", False), ("https://", False),
])
def test_links(spark, link, safe):
    r = spark.createDataFrame([(link,)], "l string").select(text.safe_link("l").alias("h")).first()
    assert r.h == (link if safe else None)


def test_headlines_slice_before_dropping(spark):
    items = ('[{"title": ""}, {"content": {"title": "B", "provider": {"displayName": "P"}, '
             '"clickThroughUrl": {"url": "u"}, "pubDate": "x"}}, {"title": "C"}, {"title": null}, '
             '{"title": "E"}, {"title": "F"}]')
    df = spark.createDataFrame([("A", items), ("B", None), ("C", "{broken")], "ticker string, items string")
    got = news.headlines(df).orderBy("pos").collect()
    assert [(r.pos, r.title) for r in got] == [(1, "B"), (2, "C"), (4, "E")]
    assert (got[0].publisher, got[0].link) == ("P", "u")


def test_missing_sources_are_empty(spark, tmp_path):
    assert st.read_or_empty(spark, str(tmp_path / "none"), schemas.PRICES).count() == 0
    assert st.read_wide_statements(spark, str(tmp_path / "none")).count() == 0


def test_wide_csv_statements_round_trip(spark, tmp_path):
    path = str(tmp_path / "w.csv")
    (tmp_path / "w.csv").write_text(
        "ticker,statement,line_item,2022-12-31,2023-12-31\nA,income,Total Revenue,,5.5\n")
    got = rows(st.read_wide_statements(spark, path, "csv"), "period_end")
    assert got[d("2022-12-31")].value is None and got[d("2023-12-31")].value == 5.5


def test_trade_log_columns(spark, tmp_path):
    fills = spark.createDataFrame(
        [("A", "BUY", 1, -0.5), ("PORTFOLIO", "RISK_SNAPSHOT", 0, -0.5)],
        "ticker string, action string, quantity int, var_95 double"
    ).withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    for _ in range(2):
        sinks.append_trades(fills, str(tmp_path / "log"))
    log = sinks.read_trades(spark, str(tmp_path / "log"))
    assert log.count() == 4
    got = rows(log, "action")
    assert got["BUY"].var_95 is None and got["RISK_SNAPSHOT"].var_95 == -0.5


def test_email_scan_reads_whole_texts(spark):
    long_text = "x " * 200_000 + "Late.Person@mail.test"
    df = spark.createDataFrame([(1, "a@example.com b@EXAMPLE.ORG"), (2, long_text), (3, None)],
                               "doc_id long, text string")
    got = integrity.email_leaks(df).collect()
    assert [(r.doc_id, r.address) for r in got] == [(2, "Late.Person@mail.test")]


def test_file_manifest(spark, tmp_path):
    for n, body in (("a", b"1"), ("b", b"22"), ("c", b"3")):
        (tmp_path / n).write_bytes(body)
    h = lambda b: hashlib.sha256(b).hexdigest()
    recorded = spark.createDataFrame(
        [("a", h(b"1"), 1), ("b", h(b"xx"), 3), ("d", h(b""), 0)],
        "name string, sha256 string, size_bytes long")
    got = {tuple(r) for r in integrity.verify_manifest(
        integrity.file_hashes(spark, str(tmp_path)), recorded).collect()}
    assert got == {("b", "checksum_mismatch"), ("b", "size_mismatch"), ("c", "unlisted"), ("d", "missing")}


def test_fact_filters(spark):
    raw = ('{"T": {"units": {"USD": ['
           '{"form": "10-K", "start": "2023-01-01", "end": "2023-12-31", "val": 1, "accn": "a-1", "filed": "2024-03-01"},'
           '{"form": "10-K", "start": "2023-01-01", "end": "2023-12-31", "val": 2, "accn": "a-2", "filed": "2024-02-01"},'
           '{"form": "10-K", "start": "2023-10-01", "end": "2023-12-31", "val": 3, "accn": "a-3", "filed": "2024-01-01"},'
           '{"form": "10-Q", "start": "2023-01-01", "end": "2023-12-31", "val": 4, "accn": "a-4", "filed": "2024-01-01"}]}}}')
    df = spark.createDataFrame([("A", "0001", raw), ("B", "2", "{broken")],
                               "ticker string, cik string, facts string")
    firsts = fa.first_filed(fa.annual_facts(fa.scan_facts(df))).collect()
    assert [(r.ticker, r.val) for r in firsts] == [("A", 2.0)]
    url = fa.scan_facts(df).select(fa.filing_url("cik", "accn").alias("u")).first().u
    assert url == "https://www.sec.gov/Archives/edgar/data/1/a1/a-1-index.htm"


def test_broken_snapshots_are_tagged(spark):
    raw = spark.createDataFrame(
        [("A", '{"ticker": "A", "entity_name": "x"'), ("B", '{"ticker": "C"}'), ("D", '{"ticker": "D"}')],
        "file_ticker string, doc string")
    docs = snapshots.parse(raw)
    got = rows(snapshots.load_status(docs), "file_ticker")
    assert [got[t].status for t in "ABD"] == ["malformed", "ticker_mismatch", "ok"]
    problems = rows(snapshots.check_schema(docs), "file_ticker")
    assert problems["D"].problem == "entity_name_empty"


@pytest.mark.parametrize("status, qty, label", [
    ("filled", 3.0, "ORDER FILLED"), ("rejected", 0.0, "REJECTED"), ("expired", 0.0, "EXPIRED (no fill)"),
    ("expired", 2.0, "PARTIALLY FILLED THEN EXPIRED (qty=2.00)"), ("canceled", 1.0, "CANCELED (qty=1.00)"),
    ("new", 0.0, "PENDING (status=new)"), ("partially_filled", 1.5, "PARTIALLY FILLED (qty=1.50)"),
    (None, None, "UNKNOWN"),
])
def test_fill_labels(spark, status, qty, label):
    df = spark.createDataFrame([(status, qty)], "status string, filled_qty double")
    assert df.select(orders.fill_label("rebalance").alias("l")).first().l == label


def test_failed_order_lookup_blocks_everything(spark):
    plan = spark.createDataFrame([("A",), ("B",)], "symbol string")
    busy = spark.createDataFrame([("A",)], "symbol string")
    assert [r.symbol for r in orders.without_duplicates(plan, busy).collect()] == ["B"]
    assert orders.without_duplicates(plan, busy, source_ok=False).count() == 0


def compared(spark, metric, a, b):
    from tidemark.params import METRIC_TOLERANCES

    pos = list(METRIC_TOLERANCES).index(metric)
    make = lambda v: spark.createDataFrame(
        [("T", metric, pos, v)], "ticker string, metric string, metric_pos int, value double")
    return rc.compare(make(a), make(b)).first().passed


@pytest.mark.parametrize("metric, a, b, ok", [
    ("wacc", 0.1004, 0.1, True), ("wacc", 0.1006, 0.1, False),
    ("fcf_year_1", 100.1, 100.0, True), ("fcf_year_1", 100.2, 100.0, False),
    ("equity_value", 5e-7, 0.0, True), ("equity_value", 1e-3, 0.0, False),
    ("equity_value", None, 1.0, False),
])
def test_tolerances(spark, metric, a, b, ok):
    assert compared(spark, metric, a, b) is ok


def test_bias_needs_two_one_sided_differences(spark):
    df = spark.createDataFrame(
        [("up", 2.0, 1.0), ("up", 3.0, 1.0), ("mixed", 2.0, 1.0), ("mixed", 0.0, 1.0), ("one", 2.0, 1.0),
         ("one", 1.0, 1.0)], "metric string, produced double, expected double")
    got = rows(rc.directional_bias(df), "metric")
    assert [got[m].biased for m in ("up", "mixed", "one")] == [True, False, False]


def test_pages_by_cursor_see_every_row_once(spark):
    data = [(None if i % 9 == 0 else i // 4, i) for i in range(230)]
    df = spark.createDataFrame(data, "ts int, id int")
    keys, cursor, seen = ("ts", "id"), None, []
    while True:
        part = lookup.page_after(df, keys, cursor, 40)
        seen += [tuple(r) for r in part.collect()]
        cursor = lookup.cursor_of(part, keys)
        if cursor is None:
            break
    assert seen == sorted(data, key=lambda r: (r[0] is None, -(r[0] or 0), -r[1]))
    newer = df.unionByName(spark.createDataFrame([(1000, 1000)], df.schema))
    assert lookup.page_after(newer, keys, seen[39], 40).collect()[0].id == seen[40][1]
    with pytest.raises(ValueError):
        lookup.page_after(df, keys, (1,))


def test_cursor_predicate_reaches_the_scan(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("ts"), "id").write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    plan = lookup.page_after(table, ("ts", "id"), (50, 50))._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(ts,50)" in plan and "TakeOrderedAndProject" in plan


def test_half_written_generations_are_invisible(spark, tmp_path):
    schema = "generated_at timestamp_ntz, sector string, median double"
    path = str(tmp_path / "medians")

    def rows_of(day, *sectors):
        return spark.createDataFrame([(datetime(2024, 1, day), s, 1.0) for s in sectors], schema)

    def newest():
        got = sinks.newest_snapshot(spark, path, rows_of(1).schema).collect()
        return [(r.generated_at.day, r.sector) for r in sorted(got, key=lambda r: r.sector)]

    assert newest() == []
    sinks.publish_snapshot(rows_of(1, "a", "b"), path)
    assert newest() == [(1, "a"), (1, "b")]
    # a publisher that died: data files of a newer generation, no marker
    rows_of(2, "a").write.parquet(f"{path}/data/generation=dead")
    assert newest() == [(1, "a"), (1, "b")]
    assert sinks.publish_snapshot(rows_of(2), path) is None and newest() == [(1, "a"), (1, "b")]
    sinks.publish_snapshot(rows_of(2, "a", "c"), path)
    assert newest() == [(2, "a"), (2, "c")]


def test_own_tags_replace_the_usual_ones_and_totals_are_not_added_to_parts(spark):
    schema = ("ticker string, cik string, tag string, pos int, form string, start date, end date, val double, "
              "accn string, filed date")
    end, start, filed = d("2020-12-31"), d("2020-01-01"), d("2021-02-01")
    flows = {"Revenues": 100.0, "IncomeTaxExpenseBenefit": 5.0, "InterestExpense": 3.0, "InterestPaidNet": 2.0,
             fa.FIELD_TAGS["pretax"][0]: 20.0}
    debts = {"LongTermDebtNoncurrent": 40.0, "LongTermDebtCurrent": 4.0, "ShortTermBorrowings": 2.0, "DebtCurrent": 7.0}
    facts = [(n, "7", tag, 0, "10-K", start, end, v, "a-1", filed) for n in "ABCD" for tag, v in flows.items()]
    facts += [(n, "7", tag, 0, "10-K", None, end, v, f"a-{i}", filed)
              for n in "ABC" for i, (tag, v) in enumerate(debts.items()) if not (n == "A" and tag == "DebtCurrent")]
    facts += [("C", "7", "DebtLongtermAndShorttermCombinedAmount", 0, "10-K", None, end, 50.0, "a-9", filed)]
    own = spark.createDataFrame([
        ("B", "interest", "InterestPaidNet", 0, "proxy_cash_paid_interest"),
        ("D", "interest", "NeverReported", 0, "reported"),
    ], fa.TAG_MAP)
    sheets = fa.company_sheets(spark.createDataFrame(facts, schema), own)
    got = rows(fa.extract_companies(sheets), "ticker")
    assert [got[n].interest for n in "ABCD"] == [3.0, 2.0, 3.0, None]
    assert got["B"].interest_method == "proxy_cash_paid_interest" and got["A"].interest_method == "reported"
    assert [got[n].total_debt for n in "ABCD"] == [46.0, 47.0, 50.0, None]
    assert got["B"].component_tags == "LongTermDebtNoncurrent; DebtCurrent" and got["B"].accessions == "a-0; a-3"
    parts = {(r.ticker, r.tag): (r.use, r.covered_by) for r in fa.debt_components(sheets[2]).collect()}
    assert parts["A", "LongTermDebtCurrent"] == ("added", None)
    assert parts["B", "LongTermDebtCurrent"] == ("part", "DebtCurrent") and parts["B", "DebtCurrent"] == ("added", None)
    assert {use for (n, _), (use, _) in parts.items() if n == "C"} == {"combined"} and len(parts) == 11
    plain = rows(fa.extract_companies(fa.company_sheets(spark.createDataFrame(facts, schema))), "ticker")
    assert plain["B"].interest == plain["D"].interest == 3.0
    assert fa.extract_companies(fa.company_sheets(spark.createDataFrame([], schema), own)).collect() == []
